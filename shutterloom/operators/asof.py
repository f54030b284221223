"""The nearest rows of another table: an as-of join by merging two orders.

Both tables are laid in one order, by key and then by place, in range partitions. Each range knows the last and the
first row of the other table within it, and takes over those of the ranges before and after, so that no task holds
more than its ranges, however many rows share a key or a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import column, packed, unpacked
from .ordering import ordered, settled

#: Places of the merged order in a range.
SPAN = 50_000


def carried(rows: DataFrame, value: Column, back: bool, ahead: bool, order: str = "ord", span: int = SPAN) -> DataFrame:
    """rows, which have a dense order, with _back and _ahead: the last and next ``value`` that is not null, before and after the row itself.

    ``rows`` is read twice. The windows go by ranges of the order; there is a row for each range besides, which is
    broadcast. As many partitions as there are ranges are made, so that a task sorts a few of them however large the
    table is. The next value is the last one of the order turned round, as windows to the end of a partition take
    quadratic time.
    """
    rows = rows.withColumns({"_range": F.floor(F.col(order) / span), "_value": value})
    held = F.when(F.col("_value").isNotNull(), F.col(order))
    ends = settled(rows.groupBy(F.col("_range").alias("_of")).agg(F.max_by("_value", held).alias("_last"), F.min_by("_value", held).alias("_first")))
    parts = max(1, ends.count())
    turned = F.desc("_of")  # a row for each range
    before, past = (Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.asc("_of"), turned))
    ends = ends.select("_of", F.last("_last", ignorenulls=True).over(before).alias("_from_before"), F.last("_first", ignorenulls=True).over(past).alias("_from_after"))
    rows = rows.repartition(parts, "_range").join(F.broadcast(ends), F.col("_range") == F.col("_of"))
    for wanted, name, direction, outside in ((back, "_back", F.asc(order), "_from_before"), (ahead, "_ahead", F.desc(order), "_from_after")):
        if wanted:
            inner = Window.partitionBy("_range").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inner), outside))
    return rows.drop("_range", "_value", "_of", "_from_before", "_from_after")


def asof(
    left: DataFrame, right: DataFrame, on: str | tuple[str, str], by: tuple[str, ...] = (), direction: str = "nearest", exact: bool = True, tolerance: Column | None = None,
    ties: tuple[str, ...] = (), span: int = SPAN,
) -> DataFrame:
    """left with ``match``, a struct of right's columns: the row of right that is nearest in ``on`` among those alike in ``by``.

    direction is backward (the last at or before), forward (the first at or after) or nearest, of which the earlier
    goes where both are equally far. Without ``exact`` rows at the same place do not count; that is for one direction
    only. Farther than ``tolerance``, or with a null in ``on`` or ``by``, nothing matches and match is null. Of several
    rows of right at one place the last by ``ties`` counts going back, the first going ahead. No row of left is lost or
    doubled; repeated rows match alike. Empty tables give no rows, or no matches. A column match of left is replaced.
    """
    if direction not in ("backward", "forward", "nearest") or direction == "nearest" and not exact:
        raise ValueError("direction must be backward, forward or nearest; nearest takes equal places too")
    a, b = (on, on) if isinstance(on, str) else on
    names, keys = [c for c in left.columns if c != "match"], [f"_k{i}" for i in range(len(by))]
    # at one place the side that may match lies where the other finds it
    mine = 0 if (direction == "forward") == exact else 1
    payload = F.struct(*[column(c).alias(c) for c in right.columns])
    other = right.where(F.expr("true"))
    for c in (b, *by):
        other = other.where(column(c).isNotNull())
    other = other.select(*[column(c).alias(k) for c, k in zip(by, keys, strict=True)], column(b).alias("_t"), F.lit(1 - mine).alias("_side"), *[column(c).alias(f"_s{i}") for i, c in enumerate(ties)], payload.alias("_hit"))
    own = left.select(*[column(c).alias(k) for c, k in zip(by, keys, strict=True)], column(a).alias("_t"), F.lit(mine).alias("_side"), packed(left, names, "_left"))
    rows = own.unionByName(other, allowMissingColumns=True)
    # the hash parts rows that are alike in all the rest, so that a range border can lie between them
    rows = ordered(rows, *keys, "_t", "_side", *[f"_s{i}" for i in range(len(ties))], F.xxhash64("_left", "_hit"), name="ord")
    hit = F.when(F.col("_hit").isNotNull(), F.struct(*keys, "_t", "_hit"))
    back, ahead = direction != "forward", direction != "backward"
    rows = carried(rows, hit, back, ahead, span=span).where(F.col("_left").isNotNull())

    def valid(side: str, far: Column) -> Column:
        alike = F.col("_t").isNotNull()
        for k in keys:
            alike = alike & F.coalesce(F.col(k) == F.col(f"{side}.{k}"), F.lit(False))
        return F.when(alike if tolerance is None else alike & (far <= tolerance), F.col(side))

    gap = {"_back": F.col("_t") - F.col("_back._t"), "_ahead": F.col("_ahead._t") - F.col("_t")}
    found = [valid(side, gap[side]) for side, wanted in (("_back", back), ("_ahead", ahead)) if wanted]
    match = found[0]["_hit"]
    if direction == "nearest":
        rows = rows.withColumns({"_b": found[0], "_a": found[1], "_near": gap["_back"] <= gap["_ahead"]})
        match = F.when(F.col("_a").isNull() | (F.col("_b").isNotNull() & F.col("_near")), F.col("_b._hit")).otherwise(F.col("_a._hit"))
    return rows.select(*unpacked(names, "_left"), match.alias("match"))
