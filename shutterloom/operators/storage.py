"""Feature-store eviction, session catalog, folder statistics and file-operation plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import summaries

#: Fixed values.
LOW_WATER, RECENTS, RECENT_DAYS, ERRORS_SHOWN = 0.9, 5, 14, 20


def evicted(entries: DataFrame, cap: int, bucket: Column | None = None) -> DataFrame:
    """Entries (path, used, bytes) to remove, least recently used first, until at most 90 % of the cap is left.

    Nothing goes while the total is within the cap. Sums before each entry go by buckets of ``used``.
    """
    entries = entries.withColumn("_b", F.floor(F.col("used") / 100_000) if bucket is None else bucket)
    sums = entries.groupBy("_b").agg(F.sum("bytes").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    sums = sums.select(F.col("_b").alias("_of"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
    inner = F.coalesce(F.sum("bytes").over(Window.partitionBy("_b").orderBy("used", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entries = entries.withColumn("_in", inner).join(sums, F.col("_b") == F.col("_of"))
    left = F.col("_total") - F.col("_before") - F.col("_in")
    return entries.where((F.col("_total") > cap) & (left > cap * LOW_WATER)).drop("_b", "_of", "_before", "_total", "_in")


def recents(entries: DataFrame, now: Column) -> DataFrame:
    """The session catalog: newest entry of each set of folders, none older than 14 days or of unreadable date, 5 at most."""
    entries = entries.withColumn("_at", F.try_to_timestamp("last_opened")).where(F.col("_at") >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
    entries = entries.withColumn("_key", F.array_join(F.array_sort("paths"), "\0"))
    # entries of one time go by their other columns, so that a rerun picks the same
    newest = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_at"), F.desc(F.to_json(F.struct(*[c for c in entries.columns if not c.startswith("_")])))))
    return entries.withColumn("_n", newest).where("_n = 1").orderBy(F.desc("_at"), "_key").limit(RECENTS).drop("_at", "_key", "_n")


def folders(images: DataFrame) -> DataFrame:
    """src_folder, first_ord, n, rated: source folders in the order in which they are first seen."""
    return images.groupBy("src_folder").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated")).orderBy("first_ord")


def resume_position(images: DataFrame) -> DataFrame:
    """One row, ord: the first unrated frame, else 0."""
    return images.agg(F.coalesce(F.min(F.when(F.col("rating").isNull(), F.col("ord"))), F.lit(0)).alias("ord"))


def transfer_plan(wanted: DataFrame, existing: DataFrame, target: str) -> DataFrame:
    """source, dest, action for frames (path) to move or copy: do, skip_exists or skip_missing.

    ``existing`` (path) is what there is. A destination that exists is never overwritten; of two sources with one
    name the first by path goes.
    """
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    plan = wanted.select(F.col("path").alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), name).alias("dest")).distinct()
    there = existing.select("path").distinct()
    plan = plan.join(there.select(F.col("path").alias("_s"), F.lit(True).alias("_has")), F.col("source") == F.col("_s"), "left")
    plan = plan.join(there.select(F.col("path").alias("_d"), F.lit(True).alias("_taken")), F.col("dest") == F.col("_d"), "left")
    first = F.row_number().over(Window.partitionBy("dest").orderBy("source")) == 1
    action = F.when(F.col("_has").isNull(), "skip_missing").when(F.col("_taken").isNotNull() | ~first, "skip_exists").otherwise("do")
    return plan.select("source", "dest", action.alias("action"))


def _sidecar(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return (folder + "/" if folder else "") + name.rsplit(".", 1)[0] + ".xmp"


def transferred(plan: DataFrame, move: bool) -> DataFrame:
    """Carries a plan of transfer_plan() out: source, action, error. Sidecars follow their photographs, as far as they can.

    Each photograph is one task's, in any store that Arrow opens. What exists is never overwritten, and a source that
    has gone is skipped, so a task that runs again, or a plan carried out twice, does no harm. A failure is a row, and
    the others go on; so is a sidecar that cannot follow no failure of its photograph. A run that stops half way leaves
    those done that were; sources.fileops.carry_out() commits a whole plan or nothing, and keeps times.
    """

    def open_(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))

    def there(path: str) -> bool:
        system, inner = open_(path)
        return system.get_file_info(inner).type == pyarrow.fs.FileType.File

    def carry(source: str, dest: str) -> None:
        (a, x), (b, y) = open_(source), open_(dest)
        b.create_dir(y.rpartition("/")[0], recursive=True)
        if move and a.equals(b):
            a.move(x, y)
            return
        # under another name first, so that a half copy is never taken for a whole one
        pyarrow.fs.copy_files(x, f"{y}.part", source_filesystem=a, destination_filesystem=b)
        b.move(f"{y}.part", y)
        if move:
            a.delete_file(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            actions, errors = [], []
            for source, dest, action in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                error = None
                try:
                    if action == "do" and there(dest):
                        action = "skip_exists"
                    elif action == "do" and not there(source):
                        action = "skip_missing"
                    elif action == "do":
                        carry(source, dest)
                        try:
                            if there(_sidecar(source)) and not there(_sidecar(dest)):
                                carry(_sidecar(source), _sidecar(dest))
                        except (OSError, pa.ArrowException):
                            pass
                except (OSError, pa.ArrowException) as e:
                    error = f"{source}: {e}"
                actions.append(action)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(actions, pa.string()), pa.array(errors, pa.string())], ["source", "action", "error"])

    return plan.select("source", "dest", "action").mapInArrow(run, "source string, action string, error string")


def transfer_result(outcomes: DataFrame) -> DataFrame:
    """One row from (action, error): done, skipped, failed and the first errors by source."""
    shown = outcomes.where("error is not null").select("source", "error").orderBy("source").limit(ERRORS_SHOWN).agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "error"))), lambda x: x["error"]).alias("errors"))
    sums = outcomes.agg(F.count_if((F.col("action") == "do") & F.col("error").isNull()).alias("done"), F.count_if(F.col("action") != "do").alias("skipped"), F.count("error").alias("failed"))
    return sums.join(F.broadcast(shown))


def lower_percentiles(rows: DataFrame, key: list[str], value: Column, bins: int, top: float) -> DataFrame:
    """p5, p95 and their spread for each key, from a histogram: the first bin whose cumulative count reaches the target."""
    return summaries.spread(summaries.histogram(rows, key, value, bins, top), key, bins)


def lowest_median(rows: DataFrame, key: str, value: str, most: int = 16) -> DataFrame:
    """The lower median of the ``most`` smallest values of each key."""
    return summaries.noise_floor(summaries.lowest(rows, key, value, most), key)
