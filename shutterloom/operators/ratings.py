"""Ratings as an append-only event log: current state, filters, counts and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import SPAN, carried

#: Fixed values.
RATINGS = ("keep", "reject", "favorite")
FILTERS = ("all", "unrated", "keeps", "rejects", "favorites", "suggested", "suggested_keep", "suggested_reject", "suggested_favorite")
#: The filters behind each tab, the first its own; the width in pixels that takes up the middle size and that which lets it go.
CYCLES = {"all": ("all",), "unrated": ("unrated",), "keeps": ("keeps", "favorites"), "suggested": ("suggested", "suggested_reject", "suggested_keep", "suggested_favorite")}
ENGAGE, RELEASE = 1750, 1650
ATTEMPTS = 4


def current(events: DataFrame) -> DataFrame:
    """img_id, rating: the last ``after`` of each image by seq; cleared ones have none. Changes of nothing do not count."""
    changed = events.where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.groupBy("img_id").agg(F.max_by("after", "seq").alias("rating")).where("rating is not null")


def latest(scores: DataFrame, key: str = "id", seq: str = "seq", generation: int | None = None) -> DataFrame:
    """The last row of each key; rows of another generation are late and dropped."""
    rows = scores if generation is None else scores.where(F.col("gen") == generation)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")


def unrated_from(frames: DataFrame, at: int, direction: int, skip: int | None = None) -> DataFrame:
    """One row, ord: the next (direction 1) or previous (-1) unrated frame from the place ``at``, other than the frame ``skip``; null if there is none."""
    free = frames.where(F.col("rating").isNull() & ~F.coalesce(F.col("id") == F.lit(skip), F.lit(False)))
    return free.where(F.col("ord") > at).agg(F.min("ord").alias("ord")) if direction > 0 else free.where(F.col("ord") < at).agg(F.max("ord").alias("ord"))


def next_challenger(frames: DataFrame, challenger: int, champion: int | None) -> DataFrame:
    """One row, ord: after a duel, the nearest unrated frame to the challenger's place, ahead first, then behind; null if none is left."""
    at = frames.where(F.col("id") == challenger).agg(F.max("ord").alias("_at"))
    free = frames.where(F.col("rating").isNull() & (F.col("id") != challenger) & ~F.coalesce(F.col("id") == F.lit(champion), F.lit(False))).select("ord")
    ahead, behind = F.min(F.when(F.col("ord") > F.col("_at"), F.col("ord"))), F.max(F.when(F.col("ord") < F.col("_at"), F.col("ord")))
    return free.join(F.broadcast(at)).agg(F.coalesce(ahead, behind).alias("ord"))


def passes(mode: str, rating: Column, verdict: Column) -> Column:
    """Whether a frame is visible under a filter. Suggestions count only on unrated frames."""
    free = rating.isNull()
    kept = rating.isin("keep", "favorite")
    if mode == "suggested":
        return free & verdict.isNotNull()
    if mode.startswith("suggested_"):
        return F.coalesce(free & (verdict == mode.removeprefix("suggested_")), F.lit(False))
    return F.coalesce({"all": F.lit(True), "unrated": free, "keeps": kept, "rejects": rating == "reject", "favorites": rating == "favorite"}[mode], F.lit(False))


def next_filter(current: Column, tab: str) -> Column:
    """The filter after a press of a tab: its first one, or from one of its own the one after."""
    cycle = CYCLES[tab]
    after = F.lit(cycle[0])
    for here, there in zip(cycle, (*cycle[1:], cycle[0]), strict=True):
        after = F.when(current == here, F.lit(there)).otherwise(after)
    return after


def has_stars(stars: Column) -> Column:
    """Whether a frame carries stars of another program."""
    return F.coalesce(stars >= 1, F.lit(False))


def empty_state(enabled: Column, on_open: Column, analysing: Column, scored: Column) -> Column:
    """Why there are no suggestions to show."""
    return F.when(~enabled, "disabled").when(analysing, "analyzing").when(scored > 0, "analyzedNoSuggestions").when(on_open, "notAnalyzedAutoStart").otherwise("notAnalyzedManual")


def engaged(widths: DataFrame, key: str = "key", seq: str = "seq", width: str = "width") -> DataFrame:
    """widths with engaged: taken up over ENGAGE, let go under RELEASE, held in between and where the width is unknown; at first not.

    The last width that decides, of those up to a row, is looked up in a window over each key's rows.
    """
    decides = F.when(F.col(width) > ENGAGE, True).when(F.col(width) < RELEASE, False)
    so_far = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return widths.withColumn("engaged", F.coalesce(F.last(decides, ignorenulls=True).over(so_far), F.lit(False)))


def tier_errors(failures: DataFrame) -> DataFrame:
    """path, attempts, last_error, next_retry_ms, terminal from failed reads (path, at_ms, error): a wait that doubles, and none after four."""
    from ..functions.expr import backoff_ms

    found = failures.groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("error", F.struct("at_ms", "error")).alias("last_error"), F.max("at_ms").alias("_at"))
    terminal = F.col("attempts") >= ATTEMPTS
    return found.select("path", "attempts", "last_error", F.when(~terminal, F.col("_at") + backoff_ms(F.col("attempts"))).alias("next_retry_ms"), terminal.alias("terminal"))


def unrated(images: DataFrame, ratings: DataFrame) -> DataFrame:
    return images.join(ratings, images["id"] == ratings["img_id"], "left_anti")


def work_list(images: DataFrame, ratings: DataFrame, scored: DataFrame, attempted: DataFrame) -> DataFrame:
    """Images neither rated nor scored nor tried: put before the costly features, as Spark does not move filters there."""
    return unrated(images, ratings).join(scored.select("id"), "id", "left_anti").join(attempted.select("id"), "id", "left_anti")


def counts(images: DataFrame, ratings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row: total, rated, unrated, keeps (favourites too), favorites, rejects, suggested (on unrated frames)."""
    every = images.select("id").join(ratings, F.col("id") == F.col("img_id"), "left").join(suggestions.select(F.col("id").alias("_s"), "verdict"), F.col("id") == F.col("_s"), "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    r = F.col("rating")
    return every.agg(
        F.count(F.lit(1)).alias("total"), n(r.isNotNull()).alias("rated"), n(r.isNull()).alias("unrated"), n(r.isin("keep", "favorite")).alias("keeps"),
        n(r == "favorite").alias("favorites"), n(r == "reject").alias("rejects"), n(r.isNull() & F.col("verdict").isNotNull()).alias("suggested"),
    )


def neighbours(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """frames (ord, rating), a table, with next_unrated, previous_unrated: the nearest unrated ord after and before, null at the ends."""
    free = F.when(F.col("rating").isNull(), F.col("ord"))
    return carried(frames, free, True, True, span=span).withColumnsRenamed({"_ahead": "next_unrated", "_back": "previous_unrated"})


def snapped(visible: DataFrame, index: int) -> DataFrame:
    """One row: the visible ord nearest to an index, the earlier of two."""
    return visible.agg(F.min_by("ord", F.struct(F.abs(F.col("ord") - index), F.col("ord"))).alias("ord"))


def between(visible: DataFrame, first: int, last: int) -> DataFrame:
    """Visible frames from one id to another, both included; none if either is not visible."""
    ends = visible.where(F.col("id").isin(first, last)).agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi"), F.countDistinct("id").alias("_n"))
    ends = ends.where(F.col("_n") == len({first, last}))
    return visible.join(F.broadcast(ends), F.col("ord").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_n")


def merged_meta(rows: DataFrame) -> DataFrame:
    """The last row of each path by seq; only lrc_rating and phash carry over from earlier rows where it has none."""
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("lrc_rating", "phash")})
    return latest(carried, "path")


def confusion(suggested: DataFrame, truth: DataFrame) -> DataFrame:
    """outcome, n: suggested (id, verdict) against truth (id, rejected): hit, false_reject, miss, quiet, unlabeled."""
    both = suggested.join(truth, "id", "left")
    flagged = F.coalesce(F.col("verdict") == "reject", F.lit(False))
    outcome = F.when(F.col("rejected").isNull(), "unlabeled").when(flagged & F.col("rejected"), "hit").when(flagged, "false_reject").when(F.col("rejected"), "miss").otherwise("quiet")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
