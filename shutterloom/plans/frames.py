"""Frames made from the events table: a deterministic stand-in for a folder of scored photographs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import epoch_ms
from ..operators import islands, verdict, winner
from ..operators.ordering import capture_order, settled

#: An hour between frames of a run: the events are that sparse.
BURST = islands.BurstRule(gap_ms=3_600_000, coarse_ms=7_200_000)
SIMILAR = islands.SimilarRule(window_ms=3_600_000, max_hamming=12, min_cosine=0.92)
_K = 2_654_435_761


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames without their order."""
    e, v = F.col("event_id"), F.col("value")
    ms = epoch_ms(F.col("ts"))
    rows = table(spark, sf_dir, "events").select(
        e.alias("id"), F.col("event_type").alias("src_folder"), F.concat("event_type", F.lit("/img"), e.cast("string"), F.lit(".CR3")).alias("path"),
        ms.alias("captured_ms"), F.when(e % 13 != 0, (e % 1000).cast("int")).alias("sub_sec_ms"), (ms + e % 7).alias("mtime_ms"),
        (e % 5).cast("int").alias("drive_mode"), (F.floor(e / 4) % 2 * 25 + 25).cast("double").alias("focal_mm"), (e % 11 != 0).alias("has_input"),
        F.lpad(F.hex(F.floor(e / 3) * _K), 16, "0").alias("phash"), F.lit(None).cast("array<double>").alias("embedding"),
        F.least(v / 100, F.lit(1.0)).alias("af"), (e % 4 != 0).alias("af_valid"), (e % 9 / 15.0).alias("af_texture"),
        F.least(v / 150, F.lit(1.0)).alias("global_sharpness"), (e % 8 / 40.0).alias("global_texture"), F.least(v / 90, F.lit(1.0)).alias("tenengrad"),
        (e % 100 / 150.0).alias("blown_pct"), (e % 37 / 74.0).alias("crushed_pct"), (1 - e % 50 / 100.0).alias("exposure_score"),
        (e % 10 / 10.0).alias("motion_blur_likelihood"), F.lit(True).alias("decode_ok"), (e % 97 / 97.0).alias("aesthetic"),
        F.when(e % 3 == 0, e % 20 / 20.0).alias("eyes_open"), F.when(e % 3 == 0, e % 30 / 30.0).alias("face_sharpness"),
        ((e % 100 / 150.0) + (e % 37 / 74.0)).alias("clip_sum"), (e % 17 != 0).alias("scored"),
        F.when(e % 6 == 0, F.when(e % 4 == 0, "keep").when(e % 10 == 0, "favorite").otherwise("reject")).alias("rating"),
    )
    return rows.withColumn("faces", F.when(F.col("eyes_open").isNotNull(), F.array(F.struct(F.array(*[F.lit(0.1)] * 4).alias("bbox"), "eyes_open", "face_sharpness"))))


#: What bursts, sets and winners look at.
BURST_INPUTS = ("id", "src_folder", "has_input", *islands.BURST_KEYS)
SET_INPUTS = tuple(dict.fromkeys((*BURST_INPUTS, *islands.SIMILAR_KEYS)))
WINNER_INPUTS = ("scored", "decode_ok", "exposure_score", "af", "global_sharpness", "clip_sum", "eyes_open", "face_sharpness")


def frames(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The frames in capture order. The order is a table, so only the columns asked for, if any, are written to it."""
    rows = scored(spark, sf_dir)
    return capture_order(rows.select(*dict.fromkeys((*names, "mtime_ms", "path"))) if names else rows)


def grouped(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The frames with bursts and sets, and the columns asked for."""
    return islands.similar_sets(settled(islands.bursts(frames(spark, sf_dir, *SET_INPUTS, *names), BURST)), SIMILAR)


def judged(spark: SparkSession, sf_dir: str, level: str = "low", change: dict[str, Column] | None = None) -> DataFrame:
    """Their verdicts by a level. Groups are found over what they look at; the scores join in after that."""
    rows = scored(spark, sf_dir).drop(*SET_INPUTS[1:], "path").withColumns(change or {})
    groups = grouped(spark, sf_dir).select(F.col("id").alias("_id"), "ord", "burst_group", "burst_pos", "burst_len", "sim_group", "sim_pos", "sim_len")
    rows = settled(rows.join(groups, F.col("id") == F.col("_id")).drop("_id").withColumn("eligible", verdict.keep_eligible(verdict.LEVELS[level])))
    return verdict.with_verdict(winner.with_winner(winner.with_winner(rows, "burst"), "sim"), level)


#: The same in SQL; CTEs f (frames), b (with bursts), s (with similar sets too).
FRAMES_SQL = f"""
f0 AS (
  SELECT event_id AS id, event_type AS src_folder, event_type || '/img' || event_id || '.CR3' AS path, epoch_us(ts) // 1000 AS captured_ms,
    CASE WHEN event_id % 13 <> 0 THEN event_id % 1000 END AS sub_sec_ms, epoch_us(ts) // 1000 + event_id % 7 AS mtime_ms, event_id % 5 AS drive_mode,
    CAST((event_id // 4 % 2) * 25 + 25 AS DOUBLE) AS focal_mm, event_id % 11 <> 0 AS has_input, (event_id // 3) * {_K} AS h,
    least(value / 100, 1.0) AS af, event_id % 4 <> 0 AS af_valid, least(value / 150, 1.0) AS global_sharpness, least(value / 90, 1.0) AS tenengrad, event_id % 9 / 15.0::DOUBLE AS af_texture, event_id % 8 / 40.0::DOUBLE AS global_texture,
    event_id % 100 / 150.0::DOUBLE AS blown_pct, event_id % 37 / 74.0::DOUBLE AS crushed_pct, 1 - event_id % 50 / 100.0::DOUBLE AS exposure_score,
    event_id % 10 / 10.0::DOUBLE AS motion_blur_likelihood, event_id % 97 / 97.0::DOUBLE AS aesthetic,
    CASE WHEN event_id % 3 = 0 THEN event_id % 20 / 20.0::DOUBLE END AS eyes_open, CASE WHEN event_id % 3 = 0 THEN event_id % 30 / 30.0::DOUBLE END AS face_sharpness,
    event_id % 17 <> 0 AS scored,
    CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'keep' WHEN event_id % 10 = 0 THEN 'favorite' ELSE 'reject' END END AS rating
  FROM events),
f AS (SELECT *, blown_pct + crushed_pct AS clip_sum, row_number() OVER (ORDER BY mtime_ms NULLS LAST, path) - 1 AS ord FROM f0),
b1 AS (SELECT *, lag(f) OVER (ORDER BY ord) AS p FROM f),
b2 AS (SELECT * EXCLUDE (p), CASE WHEN has_input AND p.has_input AND src_folder = p.src_folder AND drive_mode > 0 AND p.drive_mode > 0 AND abs(focal_mm - p.focal_mm) <= 0.01
    AND CASE WHEN sub_sec_ms IS NOT NULL AND p.sub_sec_ms IS NOT NULL THEN abs(captured_ms - p.captured_ms) < {BURST.gap_ms}
        ELSE abs(captured_ms - p.captured_ms) <= {BURST.coarse_ms} AND abs(mtime_ms - p.mtime_ms) < {BURST.gap_ms} END THEN 0 ELSE 1 END AS st FROM b1),
b3 AS (SELECT *, sum(st) OVER (ORDER BY ord) AS run FROM b2),
b4 AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY ord) AS k FROM b3),
b5 AS (SELECT run AS r2, row_number() OVER (ORDER BY run) - 1 AS g FROM (SELECT DISTINCT run FROM b4 WHERE n >= 2)),
b AS (SELECT b4.* EXCLUDE (st, run, n, k), g AS burst_group, CAST(CASE WHEN g IS NOT NULL THEN k END AS INTEGER) AS burst_pos, CAST(CASE WHEN g IS NOT NULL THEN n END AS INTEGER) AS burst_len
      FROM b4 LEFT JOIN b5 ON run = r2),
s1 AS (SELECT *, lag(b) OVER (ORDER BY ord) AS p FROM b),
s2 AS (SELECT * EXCLUDE (p), CASE WHEN has_input AND p.has_input AND burst_group IS NULL AND p.burst_group IS NULL AND src_folder = p.src_folder
    AND abs(captured_ms - p.captured_ms) <= {SIMILAR.window_ms} AND bit_count(xor(h, p.h)) <= {SIMILAR.max_hamming} THEN 0 ELSE 1 END AS st FROM s1),
s3 AS (SELECT *, sum(st) OVER (ORDER BY ord) AS run FROM s2),
s4 AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY ord) AS k FROM s3),
s5 AS (SELECT run AS r2, row_number() OVER (ORDER BY run) - 1 AS g FROM (SELECT DISTINCT run FROM s4 WHERE n >= 2)),
s AS (SELECT s4.* EXCLUDE (st, run, n, k), g AS sim_group, CAST(CASE WHEN g IS NOT NULL THEN k END AS INTEGER) AS sim_pos, CAST(CASE WHEN g IS NOT NULL THEN n END AS INTEGER) AS sim_len
      FROM s4 LEFT JOIN s5 ON run = r2)
"""
