"""Many short rows of numbers as blocks: one binary value holds a bucket's columns, so Spark deals out buckets and numpy works on columns.

A table of blocks has _bucket, _kind (which columns a block holds, by a number of the caller's) and _block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "_bucket int, _kind byte, _block binary"
_BYTES = 8_000_000  # of blocks in a record batch, at most, and of the last one


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The one of n buckets in which a 64-bit key lies."""
    found = mix(keys.view(np.uint64)) % np.uint64(n)
    return found.astype(np.uint16 if n <= 1 << 16 else np.int64)  # short ones are sorted by radix


def batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows of bucket, kind and block."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        where, kind, block = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(kind, pa.int8()), pa.array(block, pa.binary())], ["_bucket", "_kind", "_block"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > _BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def packed(columns: list[np.ndarray]) -> bytes:
    return b"".join([c.tobytes() for c in columns])


def dealt(kind: int, where: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A row for each bucket that has rows of the columns, which keep their order there."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(where)], strict=True):
        yield int(where[low]), kind, packed([c[low:high] for c in columns])


def unpacked(block: bytes, types: str) -> list[np.ndarray]:
    """The columns of a block, whose numpy types are named one after another, one character each."""
    kinds = [np.dtype(t) for t in types]
    n, at, columns = len(block) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        columns.append(np.frombuffer(block, k, n, at))
        at += n * k.itemsize
    return columns


def gathered(blocks: list[bytes], types: str) -> list[np.ndarray]:
    """The columns of all the blocks, one after another."""
    every = [unpacked(b, types) for b in blocks]
    return [np.concatenate([e[i] for e in every]) if every else np.zeros(0, dtype=t) for i, t in enumerate(types)]


def by_kind(table: pa.Table | pa.RecordBatch) -> dict[int, list[bytes]]:
    """Blocks of the table by their kind."""
    found: dict[int, list[bytes]] = {}
    for kind, block in zip(table.column("_kind").to_pylist(), table.column("_block").to_pylist(), strict=True):
        found.setdefault(kind, []).append(block)
    return found


def grouped(blocks: DataFrame, work: Callable[[int, dict[int, list[bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """What ``work`` makes of each bucket and its blocks by kind, as blocks again."""

    def one(table: pa.Table) -> pa.Table:
        made = list(batches(work(table.column("_bucket")[0].as_py(), by_kind(table))))
        return pa.Table.from_batches(made) if made else pa.Table.from_batches([], EMPTY)

    return blocks.groupBy("_bucket").applyInArrow(one, SCHEMA)


EMPTY = pa.schema([("_bucket", pa.int32()), ("_kind", pa.int8()), ("_block", pa.binary())])


def places(sought: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number lies among sorted ones, and whether it does."""
    if not len(among):
        return np.zeros(len(sought), dtype=np.int64), np.zeros(len(sought), dtype=bool)
    order = np.argsort(sought)
    at = np.empty(len(sought), dtype=np.int64)
    at[order] = np.minimum(np.searchsorted(among, sought[order]), len(among) - 1)
    return at, among[at] == sought


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in their order, a place of each, and for every key its place among the distinct ones."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    to = np.empty(len(keys), dtype=np.int64)
    to[order] = np.cumsum(new) - 1
    return keys[new], order[new], to


def summed(columns: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Rows alike in the first ``keys`` columns as one, in their order, the other columns summed up."""
    order = np.argsort(columns[0]) if keys == 1 else np.lexsort(columns[:keys][::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return columns
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns[:keys]:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns[:keys]] + [np.add.reduceat(c, starts) for c in columns[keys:]]
