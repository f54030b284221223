"""The best frame of a group, by an ordered fold.

The ladder compares eyes and faces only where both frames know them, so it is not transitive and no sort key exists:
members are folded in their order, and a later one replaces the best so far only if it beats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the least probability of an eye that counts as open.
OPEN = 0.5
_KEYS = ("eyes_open", "face_sharpness", "af", "global_sharpness", "clip_sum")


def beats(a: Column, b: Column) -> Column:
    """Whether a goes before b: open eyes, the sharper face, sharpness at the focus point, overall, then less clipping."""
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    a_open, b_open = a["eyes_open"] >= OPEN, b["eyes_open"] >= OPEN
    return (
        F.when(both("eyes_open") & (a_open != b_open), a_open)
        .when(both("face_sharpness") & (a["face_sharpness"] != b["face_sharpness"]), a["face_sharpness"] > b["face_sharpness"])
        .when(a["af"] != b["af"], a["af"] > b["af"])
        .when(a["global_sharpness"] != b["global_sharpness"], a["global_sharpness"] > b["global_sharpness"])
        .otherwise(a["clip_sum"] < b["clip_sum"])
    )


def winners(frames: DataFrame, group: str) -> DataFrame:
    """One row for each group: group, winner_id, winner_af; nulls where a member is not scored or none is eligible.

    ``frames`` has ord, id, scored, eligible and the ladder's columns; a group is a burst or a set, so its members
    fit in an array. A null eligible is no.
    """
    member = F.struct("ord", "id", "scored", F.coalesce("eligible", F.lit(False)).alias("eligible"), *_KEYS)
    groups = frames.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("_all"))
    none = F.element_at("_all", 1)
    able = F.filter("_all", lambda x: x["eligible"])
    better = lambda best, x: F.when(F.coalesce(beats(x, best), F.lit(False)), x).otherwise(best)
    best = F.aggregate(F.slice(able, 2, F.size(able)), F.coalesce(F.get(able, F.lit(0)), none), better)
    groups = groups.withColumn("_best", F.when(F.forall("_all", lambda x: F.coalesce(x["scored"], F.lit(False))) & (F.size(able) > 0), best))
    return groups.select(group, F.col("_best.id").alias("winner_id"), F.col("_best.af").alias("winner_af"))


def with_winner(frames: DataFrame, prefix: str) -> DataFrame:
    """frames with {prefix}_is_winner and {prefix}_margin: the winner's sharpness less a loser's own, 0 for winners and without one.

    Groups are numbers from 0; ord is not negative.
    """
    group = f"{prefix}_group"
    best = winners(frames, group).select(F.col(group).alias("_g"), "winner_id", "winner_af")
    # frames without a group get a key each that no group has: nulls would all meet in one task
    frames = frames.withColumn("_key", F.coalesce(F.col(group), -1 - F.col("ord"))).join(best, F.col("_key") == F.col("_g"), "left")
    won = F.coalesce(F.col("winner_id") == F.col("id"), F.lit(False))
    margin = F.when(won, F.lit(0.0)).otherwise(F.coalesce(F.col("winner_af") - F.col("af"), F.lit(0.0)))
    return frames.withColumns({f"{prefix}_is_winner": won, f"{prefix}_margin": margin}).drop("_key", "_g", "winner_id", "winner_af")
