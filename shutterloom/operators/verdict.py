"""Keep, reject and favourite suggestions with confidences and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import clamp01, primary_face

#: The least confidence for each level.
LEVELS = {"low": 0.5, "medium": 0.65, "high": 0.8}
#: Fixed values of the rules.
SOFT, TEXTURE, BLUR_GLOBAL, BLUR_TENENGRAD, BLUR_SCALE = 0.12, 0.12, 0.13, 0.2, 0.4
OFF_POINT, DISAGREE, DISAGREE_FACTOR, INVALID_FACTOR = 0.5, 0.35, 0.6, 0.5
BURST_SCALE, SIMILAR_FLOOR, SIMILAR_SCALE, EYES = 0.25, 0.05, 0.35, 0.2
WEIGHTS = (1.0, 0.1, 0.05, 0.05)
BLOWN, CRUSHED, CLIP_BONUS = 0.25, 0.35, 0.05
KEEP_AF, KEEP_EXPOSURE = 0.55, 0.6
FAVOURITE_AESTHETIC, FAVOURITE_SHARE, FAVOURITE_LEAST, FAVOURITE_MOST = 0.55, 0.05, 3, 15


def keep_eligible(level: float) -> Column:
    af, exposure = F.col("af"), F.col("exposure_score")
    return F.col("decode_ok") & (af >= KEEP_AF) & (exposure >= KEEP_EXPOSURE) & (F.least(af, exposure) >= level)


def _with(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rank(prefix: str) -> Column:
    return F.concat(F.col(f"{prefix}_pos").cast("string"), F.lit(" of "), F.col(f"{prefix}_len").cast("string"))


def with_verdict(frames: DataFrame, level: str | float = "medium") -> DataFrame:
    """frames with verdict (keep, reject or null), confidence, reasons and each rule's own confidence.

    ``frames`` has the scores and, from islands and winner, the group columns of bursts and similar sets. A frame that
    did not decode has no verdict, confidence 0 and no reasons. A reject below the level keeps its confidence and
    reasons without a verdict, and is not then looked at as a keep.
    """
    least = LEVELS.get(level, level)
    c, zero = F.col, F.lit(0.0)
    soft = clamp01((SOFT - c("af")) / SOFT * F.when(c("af_valid"), 1.0).otherwise(INVALID_FACTOR) * F.when(F.abs(c("tenengrad") - c("af")) > DISAGREE, DISAGREE_FACTOR).otherwise(1.0))
    soft = F.when((c("af") < SOFT) & (c("af_texture") >= TEXTURE), soft).otherwise(zero)
    frames = frames.withColumn("soft_conf", soft)
    blurred = (c("soft_conf") == 0) & (c("global_texture") >= TEXTURE) & (c("global_sharpness") < BLUR_GLOBAL) & (c("tenengrad") < BLUR_TENENGRAD)
    loser = lambda p: c(f"{p}_group").isNotNull() & ~c(f"{p}_is_winner")
    eyes = primary_face(c("faces"))["eyes_open"]
    frames = frames.withColumns(
        {
            "blur_conf": F.when(blurred, clamp01((BLUR_SCALE - c("tenengrad")) / BLUR_SCALE)).otherwise(zero),
            "burst_conf": F.when(loser("burst"), clamp01(c("burst_margin") / BURST_SCALE)).otherwise(zero),
            "similar_conf": F.when(loser("sim") & (c("sim_margin") > SIMILAR_FLOOR), clamp01((c("sim_margin") - SIMILAR_FLOOR) / SIMILAR_SCALE)).otherwise(zero),
            "eyes_conf": _with(eyes, lambda x: F.coalesce(F.when(x >= 0, F.greatest(zero, (EYES - x) / EYES)), zero)),
        }
    )
    parts = F.sort_array(F.array(F.greatest(c("soft_conf"), c("blur_conf")), F.greatest("burst_conf", zero), F.greatest("similar_conf", zero), c("eyes_conf")), asc=False)
    # the strongest, and a little of each other one; named once, as the optimizer would write it out again at every use
    summed = F.aggregate(F.zip_with(parts, F.array(*map(F.lit, WEIGHTS)), lambda x, w: x * w), zero, lambda a, x: a + x)
    blown, crushed = c("blown_pct") >= BLOWN, c("crushed_pct") >= CRUSHED
    frames = frames.withColumn("_sum", summed)
    bonus = lambda clipped: F.when(clipped, CLIP_BONUS).otherwise(0.0)
    # one bonus after the other: their sum first would round elsewhere, and a level is compared with exactly
    frames = frames.withColumn("_conf", _with(c("_sum"), lambda x: F.when(x > 0, clamp01(x + bonus(blown) + bonus(crushed))).otherwise(zero)))
    why = F.array_compact(
        F.array(
            F.when(c("soft_conf") > 0, F.when(c("motion_blur_likelihood") > OFF_POINT, F.lit("motion blur")).otherwise(F.lit("soft focus"))),
            F.when(c("blur_conf") > 0, F.lit("heavy blur")),
            F.when(c("burst_conf") > 0, F.concat(F.lit("not best of burst ("), _rank("burst"), F.lit(")"))),
            F.when(c("similar_conf") > 0, F.concat(F.lit("not best of similar set ("), _rank("sim"), F.lit(")"))),
            F.when(c("eyes_conf") > 0, F.lit("closed eyes")), F.when(blown, F.lit("blown highlights")), F.when(crushed, F.lit("crushed shadows")),
        )
    )
    best = lambda p, word: F.when(c(f"{p}_group").isNotNull(), F.lit(f"best of {word}"))
    praise = F.array_compact(F.array(best("sim", "similar set"), best("burst", "burst"), F.lit("sharp, well exposed")))
    keep = keep_eligible(least) & ~loser("burst") & ~loser("sim")
    none = F.array().cast("array<string>")
    bad = c("decode_ok") & (c("_conf") > 0)
    return frames.withColumns(
        {
            "verdict": F.when(bad, F.when(c("_conf") >= least, F.lit("reject"))).when(keep, F.lit("keep")),
            "confidence": F.when(bad, c("_conf")).when(keep, F.least("af", "exposure_score")).otherwise(zero),
            "reasons": F.when(bad, why).when(keep, praise).otherwise(none),
        }
    ).drop("_sum", "_conf")


def with_favourites(frames: DataFrame) -> DataFrame:
    """frames with the best keeps, by aesthetic, made favourites: a twentieth of all frames, 3 at least and 15 at most."""
    counted = frames.agg(F.count(F.lit(1)).alias("_n"))
    cap = F.least(F.lit(FAVOURITE_MOST), F.greatest(F.lit(FAVOURITE_LEAST), F.ceil(F.col("_n") * FAVOURITE_SHARE)))
    able = frames.where((F.col("verdict") == "keep") & (F.col("aesthetic") >= FAVOURITE_AESTHETIC))
    best = able.select(F.col("id").alias("_best"), "aesthetic").orderBy(F.desc("aesthetic"), "_best").limit(FAVOURITE_MOST)
    best = best.select("_best", F.row_number().over(_by_aesthetic()).alias("_rank")).join(F.broadcast(counted.select(cap.alias("_cap"))), F.col("_rank") <= F.col("_cap")).select("_best")
    frames = frames.join(F.broadcast(best), F.col("id") == F.col("_best"), "left")
    won = F.col("_best").isNotNull()
    return frames.withColumns({"verdict": F.when(won, F.lit("favorite")).otherwise(F.col("verdict")), "reasons": F.when(won, F.concat(F.array(F.lit("standout aesthetic")), "reasons")).otherwise(F.col("reasons"))}).drop("_best")


def _by_aesthetic():
    # over FAVOURITE_MOST rows at most
    return Window.orderBy(F.desc("aesthetic"), "_best")
