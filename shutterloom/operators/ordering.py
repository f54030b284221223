"""A total order over all frames without one task that sorts them all."""

from __future__ import annotations

import tempfile
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: The tables that settled() wrote, for sweep().
_WRITTEN: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that settled() wrote so far; says how many. Only for when no result that reads them is needed any more."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names: what is read several times is worked out once, and
    a lost executor costs nothing. Only a local session, as in tests, may leave that setting out."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, bucket: Column, *order: Column, name: str = "ord") -> DataFrame:
    """df with a dense number from 0 in the order of (bucket, *order).

    Rows are numbered inside each bucket, after the counts of the buckets before it: only one row for each bucket
    meets in one task. Choose buckets that grow with the data's span, such as hours. A null bucket comes last. df is
    read twice, the first time only for its bucket.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    df = df.withColumn("_in", within).join(counts, F.col("_bucket").eqNullSafe(F.col("_of")))
    return df.withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_bucket", "_of", "_before", "_in")


#: Bits of monotonically_increasing_id() that number rows inside a partition.
_INNER = 33


def ordered(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """df with a dense number from 0 in the order given, whatever its values are spread like.

    Rows are range-partitioned and sorted, and written as they lie; each partition's numbers go on from the counts of
    those before it. Only rows that tie in all of ``order`` must fit in a task. There is a count for each partition,
    so counts are broadcast.
    """
    place = F.monotonically_increasing_id()
    table = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part = F.shiftright("_place", _INNER)
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = table.withColumn("_of", part).join(F.broadcast(counts), F.col("_of") == F.col("_part"))
    return rows.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << _INNER) - 1)).drop("_place", "_of", "_part", "_before")


def capture_order(df: DataFrame, mtime_ms: str = "mtime_ms", path: str = "path") -> DataFrame:
    """df with ord: by modification time, unknown ones last, then by path."""
    return ordered(df, F.col(mtime_ms).asc_nulls_last(), F.col(path))


@F.pandas_udf(T.StringType())
def _composed(paths: pd.Series) -> pd.Series:
    return paths.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def staged(images: DataFrame, found: DataFrame) -> DataFrame:
    """images with those paths of ``found`` that are new, ids going on from the largest one, in path order.

    Paths are compared in their composed form, as some file systems give accents apart.
    """
    fresh = found.select(_composed("path").alias("path")).distinct().join(images, "path", "left_anti")
    fresh = numbered(settled(fresh), F.substring_index("path", "/", 3), F.col("path"), name="id")
    last = images.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_last"))  # one row
    fresh = fresh.join(F.broadcast(last)).select((F.col("id") + F.col("_last") + 1).alias("id"), "path")
    return images.select("id", "path").unionByName(fresh)
