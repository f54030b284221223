"""Suggestions that stay right while scores arrive, by deriving again what a batch touched and nothing else.

Frames whose neighbours they can form no burst and no set with are walls' edges: between two such frames a cut goes
through the order, and what is derived on one side depends on nothing on the other. A new score can only move the cuts
right before and after its frame. So a batch touches the stretches between cuts that hold its frames or their neighbours;
these are read by their buckets, derived anew, and spliced in as rows that take the place of the old ones. A
frame that loses its suggestion gets a row without one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import islands, verdict, winner
from ..operators.ordering import settled
from ..operators.ratings import latest
from ..sources.segments import Segments

#: What derive() adds to a frame.
DERIVED = ("cut_first", "cut_last", "burst_group", "burst_pos", "burst_len", "burst_is_winner", "burst_margin", "sim_group", "sim_pos", "sim_len", "sim_is_winner", "sim_margin", "verdict", "confidence", "reasons")


@dataclass(frozen=True)
class Rules:
    """What suggestions are derived by."""

    level: str = "medium"
    burst: islands.BurstRule = field(default_factory=islands.BurstRule)
    similar: islands.SimilarRule = field(default_factory=islands.SimilarRule)
    span: int = islands.SPAN


def derive(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """frames with DERIVED, without favourites. Frames need ord, dense but for gaps, which are cuts.

    Groups are named by the ord of their first frame, so that they keep their names when others change; cut_first and
    cut_last are the ends of the stretch between cuts.
    """
    frames = settled(frames.drop(*DERIVED))

    def tied(p: Column, c: Column) -> Column:
        return islands.continues_burst(p, c, rules.burst) | islands.alike(p, c, rules.similar)

    kinds = [islands.burst_run(rules.burst), islands.Run("cut", F.col("has_input"), tied, 1)]
    keys = tuple(dict.fromkeys(islands.BURST_KEYS + islands.SIMILAR_KEYS))
    rows = islands.all_runs(frames, kinds, keys, rules.span, dense=False)
    rows = rows.withColumns({"cut_first": F.col("cut_group"), "cut_last": F.col("cut_group") + F.col("cut_len") - 1}).drop("cut_group", "cut_pos", "cut_len")
    rows = islands.all_runs(settled(rows), [islands.similar_run(rules.similar)], islands.SIMILAR_KEYS, rules.span, dense=False)
    rows = settled(rows.withColumn("eligible", verdict.keep_eligible(verdict.LEVELS.get(rules.level, rules.level))))
    rows = verdict.with_verdict(winner.with_winner(winner.with_winner(rows, "burst"), "sim"), rules.level)
    return rows.select(*frames.columns, *DERIVED)


def opened(spark: SparkSession, root: str, frames: DataFrame, rules: Rules = Rules(), span: int = 50_000, merge: int = 8) -> Segments:
    """The store of a folder's frames below ``root``, derived from what is known of them at first; it is opened once."""
    store = Segments(spark, root, "ord", span, merge)
    store.write(derive(frames, rules), 0)
    return store


def _around(touched: DataFrame) -> DataFrame:
    """ord of the touched frames and their neighbours."""
    return touched.select(F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)).alias("ord")).distinct()


def rederive(store: Segments, batch: DataFrame, number: int, rules: Rules = Rules()) -> dict[str, int]:
    """Takes a batch of new values in, as write ``number``; says how many frames were read and derived.

    ``batch`` has ord and any of the frames' other columns, whose values take the place of the old ones; of several rows
    for an ord that with the largest seq counts, if it has one. Frames that the store does not know are left out. A
    batch that runs again changes nothing, and an empty one writes nothing.
    """
    if number <= store.manifest()["number"]:
        return {"read": 0, "derived": 0}
    batch = settled(latest(batch, "ord", "seq").drop("seq") if "seq" in batch.columns else batch.dropDuplicates(["ord"]))
    near = _around(batch)
    ends = store.read(store.buckets_of(near)).join(near, "ord", "left_semi").select("cut_first", "cut_last").distinct()
    ends = settled(ends)
    inner = ends.select(F.explode(F.sequence(F.floor(F.col("cut_first") / store.span), F.floor(F.col("cut_last") / store.span))).alias("b"))
    buckets = sorted(r.b for r in inner.distinct().collect())
    if not buckets:
        return {"read": 0, "derived": 0}
    held = store.read(buckets)
    new = [c for c in batch.columns if c != "ord"]
    given = batch.select(F.col("ord").alias("_of"), F.struct(*new).alias("_new"))
    rows = held.join(ends.select("cut_first"), "cut_first", "left_semi").join(given, F.col("ord") == F.col("_of"), "left")
    rows = rows.withColumns({c: F.when(F.col("_of").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in new}).drop("_of", "_new")
    made = settled(derive(rows.select(*held.columns), rules).select(*held.columns))
    store.write(made, number)
    return {"read": held.count(), "derived": made.count()}


def suggestions(store: Segments) -> DataFrame:
    """id, ord, verdict, confidence, reasons of the frames that have a suggestion now; how many are favourites goes by the scored frames."""
    rows = verdict.with_favourites(settled(store.read().where("scored").select("id", "ord", "verdict", "confidence", "reasons", "aesthetic")))
    return rows.where("verdict is not null").drop("aesthetic")


def rederived(stream: DataFrame, store: Segments, checkpoint: str, rules: Rules = Rules()) -> DataStreamWriter:
    """Takes every micro-batch of a stream of new values in. Read the store with suggestions()."""
    return stream.writeStream.foreachBatch(lambda batch, number: rederive(store, batch, number + 1, rules) and None).option("checkpointLocation", checkpoint)
