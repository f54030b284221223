"""Incremental scoring and ratings with Structured Streaming."""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import sidecar
from ..operators.ratings import latest, unrated

#: Files in a trigger from a network share and from a local disk; seconds to wait before each further try of a write.
CHUNK = {"network": 6, "local": 16}
RETRIES = (0.4, 1.5, 4.0)
#: How often a chunk is tried, and how long changes are gathered before a catch-up pass.
TRIES, DEBOUNCE = 2, "800 milliseconds"


def arriving(spark: SparkSession, root: str, schema: str, profile: str = "local") -> DataFrame:
    """Parquet files of a folder as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", CHUNK[profile]).parquet(root)


def scored(stream: DataFrame, featurise: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, generation: int, attempted: str | None = None) -> DataStreamWriter:
    """Writes the features of each micro-batch of this generation to the store; late rows of another one are dropped.

    A chunk that fails is tried once more and then skipped, so that the ones after it go on. ``attempted`` is a folder
    for the paths of all chunks, with the error of those skipped: catch-up passes leave them out. A batch that runs again
    writes its own folders again, so nothing is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk = batch.where(F.col("gen") == generation).drop("gen")
        error = None
        for _ in range(TRIES):
            try:
                featurise(chunk).withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number}")
                error = None
                break
            except Exception as e:
                error = str(e).splitlines()[0][:500]
        if attempted:
            chunk.select("path", F.lit(error).cast("string").alias("error")).write.mode("overwrite").parquet(f"{attempted}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def to_catch_up(images: DataFrame, ratings: DataFrame, scores: DataFrame, attempted: DataFrame) -> DataFrame:
    """The images (id, path) of a catch-up pass: not rated (img_id), not scored and not tried (path)."""
    return unrated(images, ratings).join(scores.select("path"), "path", "left_anti").join(attempted.select("path"), "path", "left_anti")


def catching_up(changes: DataFrame, catch_up: Callable[[], None], checkpoint: str, debounce: str = DEBOUNCE) -> DataStreamWriter:
    """Runs a catch-up pass after changes arrive, such as ratings taken back: one for all that come within the time of ``debounce``."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            catch_up()

    return changes.writeStream.foreachBatch(run).trigger(processingTime=debounce).option("checkpointLocation", checkpoint)


def standing(spark: SparkSession, store: str) -> DataFrame:
    """The scores so far: the last of each path."""
    return latest(spark.read.parquet(store), "path", "seq")


def write_sidecars(changes: DataFrame, marks: sidecar.Marks = sidecar.Marks(), retries: tuple[float, ...] = RETRIES) -> DataFrame:
    """path, error for each change (path of the sidecar, seq, rating; null clears): the last one of each path is written.

    Paths are those of a file system that all executors mount. Each path is one task's, a write replaces the file in
    one step, unchanged bytes are not written, and doing it again changes nothing. Writes that fail are tried again
    after each of ``retries``, in seconds, those of one Arrow batch together; an error is that of the last try. As a
    stream, where no task may wait, take sessions.write_queue() with writer().
    """

    def tried(path: str, value: str | None) -> str | None:
        try:
            _write(path, value, marks)
            return None
        except (OSError, KeyError) as e:
            return f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            values = {p: None if pd.isna(v) else v for p, v in zip(batch["path"], batch["rating"], strict=True)}
            errors = {p: tried(p, v) for p, v in values.items()}
            for wait in retries:
                # all that failed wait together
                if failed := [p for p, e in errors.items() if e]:
                    time.sleep(wait)
                    errors |= {p: tried(p, values[p]) for p in failed}
            yield pd.DataFrame({"path": list(errors), "error": list(errors.values())})

    return latest(changes, "path", "seq").select("path", "rating").mapInPandas(run, "path string, error string")


def writer(marks: sidecar.Marks = sidecar.Marks()) -> Callable[[str, str | None], None]:
    """What writes one rating to its sidecar, or clears it, for sessions.write_queue()."""
    return lambda path, rating: _write(path, rating, marks)


def _write(path: str, value: str | None, marks: sidecar.Marks) -> None:
    old = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    if value is None:
        new = sidecar.cleared(old, marks) if old is not None else None
        if old is not None and new is None:
            os.remove(path)
    else:
        new = sidecar.rated(old, value, marks)
    if new is None or new == old:
        return
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", prefix=os.path.basename(path) + ".", suffix=".tmp", delete=False) as f:
        f.write(new)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
