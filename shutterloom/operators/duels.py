"""Duels: a champion meets one unrated frame after the other.

The next challenger is the nearest unrated frame ahead of the last one, else the nearest behind it. Each challenger is
rated, so frames are met in an order that no verb changes: those ahead of the first challenger from near to far, then
those behind it from near to far. The champion is the last challenger that won. So a whole sequence of duels is a
ranking, a join and an as-of lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import carried
from .ordering import ordered

#: What each verb makes of champion and challenger; null leaves the champion alone.
VERBS = {"win": ("reject", "keep"), "lose": (None, "reject"), "keep_both": (None, "keep"), "favorite_both": (None, "favorite")}


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with n: the place in their session, from 0. No task holds a session."""
    rows = ordered(rows, F.col("session"), *order, name="_at")
    first = rows.groupBy(F.col("session").alias("_s")).agg(F.min("_at").alias("_first"))
    return rows.join(first, F.col("session").eqNullSafe(F.col("_s"))).withColumn("n", F.col("_at") - F.col("_first")).drop("_s", "_at", "_first")


def visited(frames: DataFrame, opened: DataFrame) -> DataFrame:
    """session, n, id, ord: the frames that each session's duels meet, in their order, the first challenger with n = 0.

    ``frames`` has session, id, ord, rating; ``opened`` (session, champion, challenger), one row a session, is the pair
    in view at first, which are ids. The champion is never met. A challenger that is not among the frames, or is null,
    gives no duels.
    """
    at = opened.alias("o").join(frames.select("session", F.col("id").alias("challenger"), F.col("ord").alias("_c")), ["session", "challenger"])
    rows = frames.join(at.select("session", "champion", "challenger", "_c"), "session")
    here = F.col("id") == F.col("challenger")
    free = F.col("rating").isNull() & ~F.coalesce(F.col("id") == F.col("champion"), F.lit(False))
    rows = rows.where(here | free).select("session", "id", "ord", (F.col("ord") < F.col("_c")).alias("_behind"), F.abs(F.col("ord") - F.col("_c")).alias("_far"))
    return _ranked(rows, F.col("_behind"), F.col("_far"), F.col("id")).select("session", "n", "id", "ord")


def duelled(frames: DataFrame, opened: DataFrame, verbs: DataFrame) -> DataFrame:
    """session, seq, champion, challenger, changes, next_champion, next_challenger: one row for each verb that counts.

    ``verbs`` has session, seq, verb (win, lose, keep_both, favorite_both); the pair judged is champion and
    challenger, changes an array of (img_id, before, after) as operators.history takes them, and next_challenger is null
    where the duels end. Verbs after that count for nothing, as do null and other ones; rows that tie in (session, seq)
    go in an arbitrary order. Frames and verbs of sessions that are not opened are left out. A frame that wins was unrated, but
    the first champion and challenger may have a rating, which is their change's before; a change of nothing is among them.
    """
    judged = _ranked(verbs.where(F.col("verb").isin(*VERBS)).select("session", "seq", "verb"), F.col("seq"), F.monotonically_increasing_id())
    met = visited(frames, opened)
    rows = judged.join(met.select("session", "n", F.col("id").alias("challenger")), ["session", "n"])
    ahead = met.select("session", (F.col("n") - 1).alias("n"), F.col("id").alias("next_challenger"))
    rows = rows.join(ahead, ["session", "n"], "left")
    rows = ordered(rows, F.col("session"), F.col("n"))
    # the last winner; one of another session before this one's first is none
    won = F.when(F.col("verb") == "win", F.struct("session", F.col("challenger").alias("id")))
    rows = carried(rows, won, True, False)
    rows = rows.join(opened.select("session", F.col("champion").alias("_first")), "session")
    own = F.when(F.col("_back.session") == F.col("session"), F.col("_back.id"))
    rows = rows.withColumn("champion", F.coalesce(own, "_first")).withColumn("_won", own.isNotNull())
    # frames met were unrated, but for the first pair
    before = frames.select("session", F.col("id").alias("_id"), F.col("rating").alias("_rating"))
    first = before.join(opened.select("session", F.col("champion").alias("_id")), ["session", "_id"]).select("session", F.col("_rating").alias("_of_first"))
    own_first = before.join(opened.select("session", F.col("challenger").alias("_id")), ["session", "_id"]).select("session", F.col("_rating").alias("_of_challenger"))
    rows = rows.join(first, "session", "left").join(own_first, "session", "left")
    table = {v: (F.lit(a), F.lit(b)) for v, (a, b) in VERBS.items()}
    loser = F.coalesce(*[F.when(F.col("verb") == v, a) for v, (a, _) in table.items()]).cast("string")
    mark = F.coalesce(*[F.when(F.col("verb") == v, b) for v, (_, b) in table.items()])
    # a champion that won was kept for it; the first challenger won with n = 0
    rated = F.when(F.col("_won"), F.lit("keep")).otherwise(F.col("_of_first"))
    old = F.when(F.col("champion").isNotNull() & loser.isNotNull(), F.struct(F.col("champion").alias("img_id"), rated.alias("before"), loser.alias("after")))
    new = F.struct(F.col("challenger").alias("img_id"), F.when(F.col("n") == 0, F.col("_of_challenger")).alias("before"), mark.alias("after"))
    crowned = F.when(F.col("verb") == "win", F.col("challenger")).otherwise(F.col("champion"))
    return rows.select("session", "seq", "champion", "challenger", F.array_compact(F.array(old, new)).alias("changes"), crowned.alias("next_champion"), "next_challenger")
