"""Folder scans and sidecars, from Spark's binaryFile source."""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the raw files' extension.
RAW = "cr3"
#: A permanent failure of a scan; all other errors may pass.
_PERMANENT = r"(?i)not found|does not exist|not a directory|path_not_found"


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\.[^./\\]*$", ""))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, mtime_ms of all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))


def _below(path: Column, root: str, ignore: str | None) -> Column:
    """Whether no folder between root and the file has the ignored name, in any case."""
    inner = F.slice(F.split(F.regexp_replace(path, r"^file:/+", "/"), "/"), len(root.rstrip("/").split("/")) + 1, 10_000)
    folders = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    return F.lit(True) if not ignore else ~F.exists(folders, lambda x: F.lower(x) == ignore.lower())


def scanned(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """The raw files of listed(), without those in pruned folders."""
    return listed(spark, root).where((_ext(F.col("path")) == RAW) & _below(F.col("path"), root, ignore))


def ignored_count(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """One row: how many other files there are, sidecars and dotfiles aside."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    other = ~_ext(F.col("path")).isin(RAW, "xmp") & ~name.startswith(".") & _below(F.col("path"), root, ignore)
    return listed(spark, root).agg(F.count_if(other).alias("ignored"))


def folder_state(root: str) -> str:
    """ok, not_found or not_a_directory, in any store that Arrow opens; other errors, which may pass, are raised."""
    system, inner = pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root.removeprefix("file:"))
    kind = system.get_file_info(inner.rstrip("/")).type
    return {pyarrow.fs.FileType.NotFound: "not_found", pyarrow.fs.FileType.Directory: "ok"}.get(kind, "not_a_directory")


def is_permanent(message: Column) -> Column:
    return message.rlike(_PERMANENT)


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """stem, content of all sidecars below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[xX][mM][pP]").load(root)
    return found.select(stem(F.col("path")).alias("stem"), F.col("content").cast("string").alias("content"))


def with_sidecar(images: DataFrame, found: DataFrame) -> DataFrame:
    """images with content, null where there is no sidecar; of several with one stem, the smallest."""
    one = found.groupBy(F.col("stem").alias("_stem")).agg(F.min("content").alias("content"))
    return images.join(one, stem(F.col("path")) == F.col("_stem"), "left").drop("_stem")


def orphaned(files: DataFrame) -> DataFrame:
    """Temporary files of sidecar writes that did not end."""
    return files.where(F.col("path").rlike(r"\.xmp\.[0-9]+\.tmp$"))
