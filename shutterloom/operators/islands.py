"""Runs of adjacent frames: bursts, similar sets and display segments.

Frames have a total order (ord, dense). A run may not bridge a frame of another folder or one without input, so it is
an unbroken stretch of ord. Frames are cut in ranges of ord, whatever their folders, and each range takes over the last
frame, and the beginning of the open run, of the ranges before it: no task holds a folder, however large.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import dot, hamming
from .ordering import numbered, settled

#: ord values in a range.
SPAN = 50_000


@dataclass(frozen=True)
class BurstRule:
    """Gap and coarse guard in milliseconds, focal tolerance in millimetres."""

    gap_ms: int = 700
    coarse_ms: int = 2000
    focal_mm: float = 0.01


@dataclass(frozen=True)
class SimilarRule:
    """Window in milliseconds, largest Hamming distance, least cosine."""

    window_ms: int = 300_000
    max_hamming: int = 10
    min_cosine: float = 0.92


def continues_burst(p: Column, c: Column, rule: BurstRule) -> Column:
    """Whether frame c goes on with the burst of p: both structs of a frame's columns."""
    apart = lambda f: F.abs(c[f] - p[f])
    both = lambda f: p[f].isNotNull() & c[f].isNotNull()
    shot = both("drive_mode") & (p["drive_mode"] > 0) & (c["drive_mode"] > 0)
    lens = both("focal_mm") & (apart("focal_mm") <= rule.focal_mm)
    precise = both("captured_ms") & both("sub_sec_ms")
    far = both("captured_ms") & (apart("captured_ms") > rule.coarse_ms)
    near = F.when(precise, apart("captured_ms") < rule.gap_ms).otherwise(~far & both("mtime_ms") & (apart("mtime_ms") < rule.gap_ms))
    return F.coalesce(shot & lens & near, F.lit(False))


def alike(p: Column, c: Column, rule: SimilarRule) -> Column:
    """Whether two frames are near in time and alike by hash or by embedding. A modification time of 0 is unknown."""
    time = lambda x: F.coalesce(x["captured_ms"], F.nullif(x["mtime_ms"], F.lit(0)))
    near = F.abs(time(c) - time(p)) <= rule.window_ms
    same = F.coalesce(hamming(p["phash"], c["phash"]) <= rule.max_hamming, F.lit(False))
    close = F.coalesce(dot(p["embedding"], c["embedding"]) >= rule.min_cosine, F.lit(False))
    return F.coalesce(near & (same | close), F.lit(False))


@dataclass(frozen=True)
class Run:
    """A kind of run: its frames are ``free``, ``linked`` takes the structs of the frame before and of the frame, and ``least`` frames make one."""

    prefix: str
    free: Column
    linked: Callable[[Column, Column], Column]
    least: int = 2


def all_runs(frames: DataFrame, kinds: list[Run], columns: tuple[str, ...], span: int = SPAN, dense: bool = True) -> DataFrame:
    """frames with {prefix}_group (dense, from 0), _pos (from 1) and _len for each kind, null outside of its runs.

    ``linked`` sees the ``columns``; frames that are not free are walls, and so are gaps in ord. Without ``dense`` a group
    is named by the ord of its first frame. ``frames`` is read twice, so it should be a table; where the runs begin is
    written to one, for all kinds in one pass.
    """
    frames = frames.withColumn("_range", F.floor(F.col("ord") / span))
    free = [F.coalesce(k.free, F.lit(False)).alias(f"_free{i}") for i, k in enumerate(kinds)]
    here = F.struct("ord", "src_folder", *free, *columns)
    last = frames.where(F.col("ord") % span == span - 1).select((F.col("_range") + 1).alias("_next"), here.alias("_last"))
    order = Window.partitionBy("_range").orderBy("ord")
    marked = frames.withColumn("_here", here).withColumn("_before", F.lag("_here").over(order)).join(last, F.col("_range") == F.col("_next"), "left")
    before, own = F.coalesce("_before", "_last"), F.col("_here")
    beside = (own["ord"] - before["ord"] == 1) & (before["src_folder"] == own["src_folder"])
    link = [beside & before[f"_free{i}"] & own[f"_free{i}"] & k.linked(before, own) for i, k in enumerate(kinds)]
    marked = marked.withColumns({f"_start{i}": F.when(~F.coalesce(x, F.lit(False)), F.col("ord")) for i, x in enumerate(link)})
    # the beginning of the run, null where it is in an earlier range
    marked = marked.withColumns({f"_first{i}": F.last(f"_start{i}", ignorenulls=True).over(order) for i in range(len(kinds))})
    marked = settled(marked.drop("_here", "_before", "_next", "_last", *[f"_start{i}" for i in range(len(kinds))]))
    opened = marked.groupBy("_range").agg(*[F.max(f"_first{i}").alias(f"_f{i}") for i in range(len(kinds))])
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    opened = opened.select((F.col("_range") + 1).alias("_next"), *[F.max(f"_f{i}").over(so_far).alias(f"_open{i}") for i in range(len(kinds))])
    marked = marked.join(opened, F.col("_range") == F.col("_next"), "left")
    marked = marked.withColumns({f"_first{i}": F.coalesce(f"_first{i}", f"_open{i}") for i in range(len(kinds))}).drop("_next", "_range", *[f"_open{i}" for i in range(len(kinds))])
    for i, k in enumerate(kinds):
        found = marked.groupBy(F.col(f"_first{i}").alias("_f")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k.least)
        found = numbered(found, F.floor(F.col("_f") / span), F.col("_f"), name="_g") if dense else found.withColumn("_g", F.col("_f"))
        marked = marked.join(found, F.col(f"_first{i}") == F.col("_f"), "left")
        pos = F.when(F.col("_g").isNotNull(), F.col("ord") - F.col(f"_first{i}") + 1)
        marked = marked.withColumns({f"{k.prefix}_group": F.col("_g"), f"{k.prefix}_pos": pos.cast("int"), f"{k.prefix}_len": F.col("_n").cast("int")}).drop(f"_first{i}", "_f", "_n", "_g")
    return marked


def runs(frames: DataFrame, free: Column, linked: Callable[[Column, Column], Column], prefix: str, columns: tuple[str, ...], least: int = 2, span: int = SPAN) -> DataFrame:
    """all_runs() of one kind."""
    return all_runs(frames, [Run(prefix, free, linked, least)], columns, span)


#: What links of each kind look at.
BURST_KEYS = ("drive_mode", "focal_mm", "captured_ms", "sub_sec_ms", "mtime_ms")
SIMILAR_KEYS = ("captured_ms", "mtime_ms", "phash", "embedding")


def burst_run(rule: BurstRule) -> Run:
    """Frames without input (has_input false) are walls."""
    return Run("burst", F.col("has_input"), lambda p, c: continues_burst(p, c, rule))


def similar_run(rule: SimilarRule) -> Run:
    """Members of bursts are walls too."""
    return Run("sim", F.col("has_input") & F.col("burst_group").isNull(), lambda p, c: alike(p, c, rule))


def bursts(frames: DataFrame, rule: BurstRule = BurstRule(), span: int = SPAN) -> DataFrame:
    """frames with burst_group, burst_pos, burst_len."""
    return all_runs(frames, [burst_run(rule)], BURST_KEYS, span)


def similar_sets(frames: DataFrame, rule: SimilarRule = SimilarRule(), span: int = SPAN) -> DataFrame:
    """frames with sim_group, sim_pos, sim_len."""
    return all_runs(frames, [similar_run(rule)], SIMILAR_KEYS, span)


def adjacent_signals(frames: DataFrame) -> DataFrame:
    """ord, dt_ms, bits, cosine for each frame but the first, against the one before: -1, -1 and NaN where either does not know.

    A frame meets the one before by a join on ord, so that no task holds more than its share.
    """
    before = frames.select((F.col("ord") + 1).alias("ord"), F.struct("captured_ms", "phash", "embedding").alias("p"))
    both = frames.join(before, "ord")
    return both.select(
        "ord", F.coalesce(F.abs(F.col("captured_ms") - F.col("p.captured_ms")), F.lit(-1)).alias("dt_ms"), F.coalesce(hamming(F.col("phash"), F.col("p.phash")), F.lit(-1)).cast("int").alias("bits"),
        F.coalesce(dot(F.col("embedding"), F.col("p.embedding")), F.lit(float("nan"))).alias("cosine"),
    )


def segments(visible: DataFrame, order: str = "ord", bucket: int = 100_000) -> DataFrame:
    """Contiguous stretches of one group in a filtered subset: seg_id, kind, grp, n, labelled, len, gap_before.

    ``visible`` has ord, burst_group, burst_len, sim_group, sim_len. A burst goes before a similar set. A group's
    first stretch is labelled. The gap before a segment is 10, or 6 right after another one.
    """
    kind = F.when(F.col("burst_group").isNotNull(), "burst").when(F.col("sim_group").isNotNull(), "similar")
    rows = numbered(visible, F.floor(F.col(order) / bucket), F.col(order), name="_i").select("_i", kind.alias("kind"), F.coalesce("burst_group", "sim_group").alias("grp"), F.coalesce("burst_len", "sim_len").alias("len"))
    rows = settled(rows.where("kind is not null"))
    by_group = Window.partitionBy("kind", "grp").orderBy("_i")
    rows = rows.withColumn("_new", F.when(F.col("_i") - F.lag("_i").over(by_group) == 1, 0).otherwise(1)).withColumn("_nth", F.sum("_new").over(by_group))
    made = rows.groupBy("kind", "grp", "_nth").agg(F.min("_i").alias("seg_start"), F.max("_i").alias("_end"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
    made = settled(numbered(made, F.floor(F.col("seg_start") / bucket), F.col("seg_start"), name="seg_id"))
    touching = made.select((F.col("_end") + 1).alias("_next"))
    made = made.join(touching, F.col("seg_start") == F.col("_next"), "left")
    gap = F.when(F.col("_next").isNotNull(), 6).otherwise(10)
    return made.select("seg_id", "kind", "grp", "seg_start", "n", (F.col("_nth") == 1).alias("labelled"), "len", gap.alias("gap_before"))
