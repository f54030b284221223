"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

Each source is cut into blocks of ``block_rows`` documents. With integer shares e of a period L, block j (from 0) of
a source is released at slot floor(j * L / e) and due by slot ceil((j + 1) * L / e). Earliest deadline first among
the released blocks meets all deadlines, so at every slot each source is less than one block away from its share of
what was sent. Shares are integers, so the schedule repeats after L slots: it is worked out once, for one period,
and every block finds its slot by arithmetic and a join with those L rows. L is the least multiple of ``period`` that
has SLOTS slots for each source.

The schedule of a period is worked out by halves, not slot by slot, so that no task holds all sources. Two halves of
a stretch are known by what each would send of its own blocks. Together, what the first leaves over and what the
second sends by itself compete for the second's slots, and the first of them by deadline get those; this goes up from
single slots to the period. On the way down, a stretch that knows which blocks it sends gives its first half the
first by deadline of those that half could send. Every step is a running count by deadline inside a stretch.

The order inside a source is that of a seeded hash. Ranks come from counts by (source, chunk), so a source with most
of the rows is never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import ordered
from .common import discard, materialise, packed, unpacked

#: The most slots of a period that are broadcast to the rows.
BROADCAST_SLOTS = 1 << 16
#: Slots for each source, at least, in a period.
SLOTS = 8
#: Stretches of up to 2 to this power slots are halved inside a task.
INNER = 10
#: Blocks whose running counts are one task's, in longer stretches.
CHUNK = 1 << 16


def _keyed(source: Column) -> Column:
    """A null source is a source of its own, apart from the empty name."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def tempered_weights(docs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """source, weight: counts to the power alpha, which lifts small sources (1 keeps proportions, 0 makes all alike)."""
    return docs.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(alpha)).alias("weight"))


def slots_for(sources: int, period: int) -> int:
    """The least multiple of the period, once at least, that has SLOTS slots for each source."""
    return period * max(1, math.ceil(SLOTS * sources / period))


def _summed(weights: DataFrame) -> DataFrame:
    """source_key, weight: one row for each source that has a weight, written."""
    w = F.col("weight").cast("double")
    some = weights.where(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")))
    return materialise(some.groupBy(_keyed(F.col("source")).alias("source_key")).agg(F.sum(w).alias("weight")))


def shares(weights: DataFrame, period: int) -> DataFrame:
    """source_key, share: integers summing to the period, by largest remainder, one at least; ties by name.

    Sources of null, non-positive or non-finite weight get none. Repeated sources add up. The period has a slot for
    each source at least, or this raises.
    """
    return _shared(_summed(weights), period)


def _shared(sums: DataFrame, period: int) -> DataFrame:
    """shares() of what _summed() wrote, which is deleted."""
    n, total = sums.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if n > period:
        raise ValueError(f"{n} sources need a period of as many slots")
    exact = (period - n) * F.col("weight") / F.lit(total or 1.0)
    parts = sums.select("source_key", F.floor(exact).alias("whole"), (exact - F.floor(exact)).alias("rest"))
    left = period - n - (parts.agg(F.sum("whole")).first()[0] or 0)
    parts = ordered(parts, F.desc("rest"), F.col("source_key"), name="_at")
    discard(sums)
    return parts.select("source_key", (F.lit(1) + F.col("whole") + (F.col("_at") < left).cast("int")).cast("int").alias("share"))


def _bit(level: int) -> Column:
    """Whether a block is sent, in the stretch of its release at that level, when this is by itself."""
    return F.shiftright("_sends", level).bitwiseAND(F.lit(1).cast("long")) == 1


def _half(level: int) -> Column:
    """Whether a block is released in the first half of a stretch of 2 ** (level + 1) slots."""
    return F.shiftright("_release", level).bitwiseAND(F.lit(1).cast("long")) == 0


def _inside(keys: list[str], able: Column, keep: int) -> Column:
    """Whether an able block is one of the first ``keep`` able ones with its keys, by deadline; tasks hold whole stretches."""
    upto = Window.partitionBy(*keys).orderBy("_prio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return able & (F.sum(able.cast("int")).over(upto) <= keep)


def _across(blocks: DataFrame, able: Column, keep: int) -> DataFrame:
    """blocks with _first: the same for the key _node, where a stretch is many tasks, by counts of its chunks."""
    blocks = blocks.withColumn("_able", able).withColumn("_part", F.shiftright("_prio", CHUNK.bit_length() - 1))
    counts = blocks.where("_able").groupBy("_node", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_node").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_node", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_node", "_part").orderBy("_prio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = blocks.withColumn("_in", F.sum(F.col("_able").cast("int")).over(upto)).join(counts, ["_node", "_part"], "left")
    return found.withColumn("_first", F.col("_able") & (F.col("_before") + F.col("_in") <= keep)).drop("_able", "_part", "_in", "_before")


def _sent_alone(blocks: DataFrame, levels: int) -> DataFrame:
    """blocks with _sends, a bit for each level (0 is a slot, ``levels`` the period)."""
    inner = min(levels, INNER)
    # of the blocks with one release no stretch inside a task sends more than it has slots; the others send nothing there
    # and are dealt out, so a task's rows are bounded
    made = _across(blocks.withColumn("_node", F.col("_release")), F.lit(True), 1 << inner)
    dealt = F.when(F.col("_first"), F.shiftright("_release", inner)).otherwise(-1 - F.shiftright("_prio", CHUNK.bit_length() - 1))
    made = made.withColumn("_range", dealt).repartition("_range")
    made = made.withColumn("_sends", _inside(["_range", "_release"], F.col("_first"), 1).cast("long"))
    for level in range(inner):
        alone = _bit(level)
        made = made.withColumn("_node", F.shiftright("_release", level + 1)).withColumn("_able", F.col("_first") & (_half(level) != alone))
        won = F.when(F.col("_able"), _inside(["_range", "_node"], F.col("_able"), 1 << level)).otherwise(alone)
        made = made.withColumn("_sends", F.col("_sends").bitwiseOR(F.when(won, F.lit(1 << (level + 1))).otherwise(F.lit(0)).cast("long")))
    made = materialise(made.drop("_range", "_node", "_able", "_first"))
    for level in range(inner, levels):
        first, alone = _half(level), _bit(level)
        found = _across(made.withColumn("_node", F.shiftright("_release", level + 1)), first != alone, 1 << level)
        won = F.when(first != alone, F.col("_first")).otherwise(alone)
        step = materialise(found.withColumn("_sends", F.col("_sends").bitwiseOR(F.when(won, F.lit(1 << (level + 1))).otherwise(F.lit(0)).cast("long"))).drop("_node", "_first"))
        discard(made)
        made = step
    return made


def schedule(shared: DataFrame, period: int) -> DataFrame:
    """slot, source_key, share, turn: which source has each slot of one period, and for the how-manieth time (from 0).

    That is earliest deadline first among the released blocks, ties to the smaller source_key; shares (one at least
    for each source) sum to the period. The rows are written.
    """
    blocks = shared.select("source_key", "share", F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("turn"))
    blocks = blocks.withColumn("_release", F.expr(f"cast(turn as bigint) * {period} div share"))
    blocks = blocks.withColumn("_due", F.expr(f"((cast(turn as bigint) + 1) * {period} + share - 1) div share"))
    levels = max(0, (period - 1).bit_length())
    blocks = _sent_alone(ordered(blocks, F.col("_due"), F.col("source_key"), name="_prio").drop("_due"), levels)
    blocks = blocks.withColumn("_node", F.lit(0).cast("long"))  # the stretch that sends a block, from the period down to a slot

    def able(level: int) -> Column:
        """What the first half could send: what comes from before, and what it sends by itself."""
        return (F.shiftright("_release", level + 1) < F.col("_node")) | (_half(level) & _bit(level))

    inner = min(levels, INNER)
    for level in reversed(range(inner, levels)):
        step = _across(blocks, able(level), 1 << level).withColumn("_node", F.col("_node") * 2 + F.when(F.col("_first"), 0).otherwise(1)).drop("_first")
        step = materialise(step)
        discard(blocks)
        blocks = step
    written = blocks
    blocks = blocks.withColumn("_range", F.col("_node")).repartition("_range")
    for level in reversed(range(inner)):
        blocks = blocks.withColumn("_able", able(level))
        blocks = blocks.withColumn("_node", F.col("_node") * 2 + F.when(_inside(["_range", "_node"], F.col("_able"), 1 << level), 0).otherwise(1))
    made = materialise(blocks.select(F.col("_node").alias("slot"), "source_key", "share", "turn"))
    discard(written)
    return made


def _chunked(rows: DataFrame, order: Column, chunk_rows: int, n: int) -> DataFrame:
    """rows with _hash and a _chunk of it."""
    return rows.withColumn("_hash", order).withColumn("_chunk", F.shiftrightunsigned("_hash", 1) % max(1, math.ceil(n / chunk_rows)))


def mix(docs: DataFrame, weights: DataFrame | None = None, period: int = 1000, block_rows: int = 16, chunk_rows: int = 2000, seed: int = 7) -> DataFrame:
    """docs with four more columns, and no row less: mix_block, mix_release, mix_deadline, mix_order (long).

    mix_order is the place in the mixed stream; sort by it to write the stream. mix_block is the block's number in
    its source, mix_release and mix_deadline its slots, of block_rows rows each; the block's own slot is mix_order
    div block_rows. Up to the slot where the first source is used up, each has sent its share of the slots so far but
    for less than a block; from then on its slots stay empty, so the bound ends there, while the others go on at their
    own pace. Texts may be of any length: none is looked at. Documents of a source without a positive weight have
    null in all four. Repeated rows get a place each; an empty table gives an empty one. Columns of docs of those names
    are replaced, others may have any name. ``weights`` has source, weight; by default tempered_weights(docs). A null
    source counts as a source. Shares are counted in slots of slots_for(sources, period), for any number of sources.
    """
    weights = tempered_weights(docs) if weights is None else weights
    names = [c for c in docs.columns if c not in ("mix_block", "mix_release", "mix_deadline", "mix_order")]
    n = docs.select(F.count(F.lit(1)).alias("rows")).first().rows
    sums = _summed(weights)
    period = slots_for(sums.count(), period)
    shared = _shared(sums, period)
    plan = schedule(shared, period).select(F.col("source_key").alias("_of"), F.col("turn").alias("_at_turn"), F.col("slot").alias("_slot"))

    key = _keyed(F.col("source")).alias("_source")
    order = F.xxhash64(F.lit(seed), "doc_id")
    counts = _chunked(docs.select("doc_id", key), order, chunk_rows, n).groupBy("_source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # shares come with the counts, which are few even for a source with most of the rows
    counts = counts.join(shared, F.col("_source") == F.col("source_key"), "left").select(F.col("_source").alias("_key"), F.col("_chunk").alias("_part"), "_before", F.col("share").alias("_share"))
    rows = _chunked(docs.select(packed(docs, names), "doc_id", key), order, chunk_rows, n)
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "_chunk").orderBy("_hash", "doc_id")) - 1)
    rows = rows.join(counts, (F.col("_source") == F.col("_key")) & (F.col("_chunk") == F.col("_part")))
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_in")).withColumn("_block", F.expr(f"_rank div {block_rows}"))
    rows = rows.withColumn("_turn", (F.col("_block") % F.col("_share")).cast("int"))
    rows = rows.join(F.broadcast(plan) if period <= BROADCAST_SLOTS else plan, (F.col("_source") == F.col("_of")) & (F.col("_turn") == F.col("_at_turn")), "left")
    return rows.select(
        *unpacked(names), F.when(F.col("_share").isNotNull(), F.col("_block")).alias("mix_block"),
        F.expr(f"_block * {period} div _share").alias("mix_release"),
        F.expr(f"((_block + 1) * {period} + _share - 1) div _share").alias("mix_deadline"),
        ((F.expr(f"(_block div _share) * {period}") + F.col("_slot")) * block_rows + F.col("_rank") % block_rows).alias("mix_order"),
    )
