"""Shards of nearly equal size that keep equal texts together: minimax contiguous partition.

Documents of one text are an atomic group; groups are ordered by the SHA-256 of their text, and each shard is an
unbroken stretch of that order. The capacity is the smallest for which a greedy walk, that fills each shard as far as
it goes, needs no more shards than there are; a group above the capacity has a shard to itself. So the largest shard
is as small as can be, and a group of a third of all bytes does not leave the other shards uneven.

The sizes of all groups are never in one place. The driver holds an outline: the bytes of stretches of the order,
which are digests with the same first digits. Two walks tell between what places the cuts must lie, one that cuts
stretches anywhere and one that cuts them nowhere, and only the stretches in there are taken apart, by two more digits
in an aggregate over the sizes, until each is a single group. That takes a few passes over 100 bytes a document.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ordered
from .common import materialise, packed, unpacked

#: Hexadecimal digits of the first outline (4096 stretches), those by which one is taken apart, and how many are in a pass.
FIRST, MORE, TAKEN = 3, 2, 512


@dataclass(frozen=True)
class Stretch:
    """Groups from one digest to another, and their bytes; a single group is ``whole``."""

    first: str
    last: str
    bytes: int
    depth: int

    @property
    def whole(self) -> bool:
        return self.first == self.last


def text_digest() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def _stretches(rows: DataFrame, inner: list[Stretch]) -> list[Stretch]:
    """The outline of all rows (digest, size), or of those in some stretches, which are TAKEN at most."""
    key = F.substring("digest", 1, FIRST)
    if inner:
        key = F.lit(None).cast("string")
        for depth in sorted({s.depth for s in inner}):
            here = F.substring("digest", 1, depth).isin([s.first[:depth] for s in inner if s.depth == depth])
            key = F.coalesce(key, F.when(here, F.substring("digest", 1, depth + MORE)))
    found = rows.select(key.alias("key"), "digest", "size").where("key is not null").groupBy("key")
    found = found.agg(F.min("digest").alias("first"), F.max("digest").alias("last"), F.sum("size").alias("bytes"))
    return [Stretch(r["first"], r["last"], r["bytes"], len(r["key"])) for r in found.collect()]


def walk(ends: list[int], whole: list[bool], capacity: int, shards: int, anywhere: bool) -> list[int]:
    """Where each of at most so many shards ends, filled one after the other; stretches are cut anywhere, or nowhere.

    ``ends`` are the places at which the stretches end. A stretch over the capacity that is a single group is a shard.
    """
    at, made = 0, []
    while ends and at < ends[-1] and len(made) < shards:
        i = bisect_right(ends, at + capacity)
        stop = ends[i - 1] if i else 0
        if anywhere and i < len(ends) and not whole[i]:
            stop = at + capacity
        if stop <= at:
            stop = ends[bisect_right(ends, at)]
        at = stop
        made.append(at)
    return made


def smallest(ends: list[int], whole: list[bool], low: int, shards: int, anywhere: bool) -> int:
    """The smallest capacity, of low or more, with which a walk gets to the end: by binary search."""
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if walk(ends, whole, middle, shards, anywhere)[-1] == ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _open(outline: list[Stretch], shards: int) -> tuple[list[Stretch], list[int]]:
    """The stretches in which a cut may lie that are not taken apart yet, and, once there are none, the places of the cuts."""
    ends, at = [], 0
    for s in outline:
        at += s.bytes
        ends.append(at)
    whole = [s.whole for s in outline]
    # a stretch within the capacity holds no group above it; only for such capacities do the two walks enclose the true one
    largest = max([s.bytes for s in outline if not s.whole], default=0)
    low = smallest(ends, whole, max(1, largest), shards, True)
    if largest > 1 and low == largest:
        return [s for s in outline if not s.whole and 2 * s.bytes > largest], []
    high = smallest(ends, whole, max(1, largest), shards, False)
    early, late = walk(ends, whole, low, shards, False), walk(ends, whole, high, shards, True)
    early, late = (x + [ends[-1]] * (shards - len(x)) for x in (early, late))
    left = [s for s, end in zip(outline, ends, strict=True) if not s.whole and any(a < end and end - s.bytes < z for a, z in zip(early, late, strict=True))]
    return left, walk(ends, whole, high, shards, False)


def boundaries(rows: DataFrame, shards: int) -> list[str]:
    """The digest with which each shard but the first begins, for rows (digest, size); there are fewer if shards stay empty."""
    outline = sorted(_stretches(rows, []), key=lambda s: s.first)
    if not outline:
        return []
    while True:
        left, cuts = _open(outline, shards)
        if not left:
            break
        left = sorted(left, key=lambda s: -s.bytes)[:TAKEN]
        gone = {s.first for s in left}
        outline = sorted([s for s in outline if s.first not in gone] + _stretches(rows, left), key=lambda s: s.first)
    starts, at = {}, 0
    for s in outline:
        starts[at] = s.first
        at += s.bytes
    return [starts[c] for c in cuts if c < at]


def shard_of(digest: Column, begins: list[str]) -> Column:
    """The shard of a digest: how many shards after the first begin at it or before."""
    return sum((F.when(digest >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_digest().alias("digest"))


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs (doc_id, text).

    The law is bytes: shards are as near to equal size as groups of equal texts allow; a null text counts as empty, so
    both are one group. size is the bytes of the text and 1 more. slot is the place in the shard, from 0 without gaps,
    by digest, then doc_id, nulls first; repeated rows, and rows that tie, get a slot each. grown_shard is null under
    this law. With fewer groups than shards some stay empty; an empty table gives an empty one. Texts of any length
    count whole. Other columns of docs, of whatever name, are not looked at.
    """
    rows = materialise(_sized(docs).withColumn("row", F.monotonically_increasing_id()))
    begins = boundaries(rows, shards)
    # no two rows are alike in this order, so that a text with most of the rows is not one task
    rows = ordered(rows.withColumn("shard", shard_of(F.col("digest"), begins)), F.col("digest"), F.col("doc_id"), F.col("row"), name="place")
    first = rows.groupBy(F.col("shard").alias("_shard")).agg(F.min("place").alias("_first"))  # a row for each shard
    rows = rows.join(F.broadcast(first), F.col("shard") == F.col("_shard"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, folder: str, shards: int = 16) -> None:
    """Writes docs, all columns, as Parquet below ``folder``/shard=0, shard=1 ...: files in the order of their names, and rows as they lie, go by slot.

    A column of docs named shard is kept under the name docs_shard. Nulls, ties and empty tables are as in assign().
    """
    sized = docs.select(packed(docs, docs.columns), F.col("doc_id").cast("long").alias("_id"), text_digest().alias("digest"), (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long").alias("size"))
    begins = boundaries(sized.select("digest", "size"), shards)
    names = [c if c != "shard" else "docs_shard" for c in docs.columns]
    rows = sized.repartitionByRange("digest", "_id").sortWithinPartitions("digest", "_id")
    rows.select(*unpacked(names), shard_of(F.col("digest"), begins).alias("shard")).write.partitionBy("shard").parquet(folder)
