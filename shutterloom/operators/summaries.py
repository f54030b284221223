"""Statistics kept with a table: summaries of its parts that merge, so that a new batch costs a pass over itself alone.

A histogram is the count of each bin, and merges by adding; the lowest values of a key are a sorted array of bounded
length, and merge by taking the lowest of both. Both are exact: the parts' summaries give what the whole gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(rows: DataFrame, key: list[str], value: Column, bins: int, top: float) -> DataFrame:
    """key, bin, n: how many values of a key fall in each of ``bins`` equal bins from 0 to ``top``; those outside go in the first or last, nulls nowhere."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins / top))).cast("int")
    return rows.where(value.isNotNull()).select(*key, place.alias("bin")).groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))


def merged_histograms(parts: DataFrame, key: list[str]) -> DataFrame:
    """Histograms of parts, one below the other, as one."""
    return parts.groupBy(*key, "bin").agg(F.sum("n").alias("n"))


def spread(hist: DataFrame, key: list[str], bins: int) -> DataFrame:
    """p5, p95 and their spread for each key: the first bin whose cumulative count reaches the target. A key has ``bins`` rows at most."""
    w = Window.partitionBy(*key)
    hist = hist.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    low, high = F.ceil(F.col("total") / 20), F.col("total") - F.floor(F.col("total") / 20)
    found = hist.groupBy(*key).agg(F.min(F.when(F.col("cum") >= low, F.col("bin"))).alias("p5"), F.min(F.when(F.col("cum") >= high, F.col("bin"))).alias("p95"))
    return found.withColumn("spread", (F.col("p95") - F.col("p5")) / (bins - 1.0))


def lowest(rows: DataFrame, key: str | list[str], value: str, most: int = 16) -> DataFrame:
    """key, lows: the ``most`` smallest values of each key, sorted; nulls are none. Only so many of a key leave a task.

    Parts of a table are summarised at once with the part as one more key, not one by one: a union of as many shuffles
    is read by as few tasks as one of them.
    """
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    low = rows.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_r", rank).where(F.col("_r") <= most)
    return low.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("lows"))


def merged_lowest(parts: DataFrame, key: str, most: int = 16) -> DataFrame:
    """The lowest values of parts, one below the other, as one."""
    return lowest(parts.select(key, F.explode("lows").alias("_v")), key, "_v", most)


def noise_floor(lows: DataFrame, key: str) -> DataFrame:
    """The lower median of each key's lowest values."""
    return lows.select(key, F.get("lows", F.floor((F.size("lows") - 1) / 2).cast("int")).alias("noise_floor"))


def keep(summary: DataFrame, root: str, batch: int) -> None:
    """Puts the summary of a batch beside those of the others; done again, it takes its own place."""
    summary.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def kept(spark: SparkSession, root: str) -> DataFrame:
    """The summaries of all batches, one below the other."""
    return spark.read.parquet(root).drop("batch")
