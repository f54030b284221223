"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import column, packed, unpacked  # noqa: F401

#: ASCII letters in lower case, and every byte that no word has as a space: words are runs of 0-9, a-z and bytes from 0x80.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: The separators of those words, as a Java character class.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def tokens(text: bytes) -> list[bytes]:
    """Words between white space (0x20, 0x09 to 0x0D), A-Z lower-cased. bytes.lower() leaves other letters alone."""
    return text.lower().split()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased as far as words go: lower() maps just two other characters to ASCII ones."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of a column, or None, without decoding."""
    column = column.cast(pa.large_binary())
    raw = column.buffers()[2]
    data = memoryview(raw) if raw is not None else memoryview(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(data[ends[i] : ends[i + 1]]) if valid is None or valid[i] else None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local session, as in tests, has one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: While a table is written, shuffle files of a query go when it ends, as its rows are in the table then.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, batch_rows: int = 2000) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: lineage ends, and a lost executor costs nothing.

    Python gets ``batch_rows`` rows at once, a few megabytes where they hold texts; short rows may come in larger batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writing = {_CLEANUP: "true", _BATCH: str(batch_rows)}
    before = {k: spark.conf.get(k, None) for k in writing}
    for k, v in writing.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
