"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Vectors are projected to a few dimensions, shifted and ordered along a Hilbert curve, for several projections and
shifts. Spark range-partitions each ordering and cuts it in blocks of BLOCK vectors; a query is compared with the
vectors of its own block and of so many blocks around it as the data ask for. What all orderings find is merged and
ranked by the exact inner product of the original vectors.

How many blocks that takes is measured on the table itself: a bounded sample of the queries is compared with all
vectors, and the least width is taken at which the orderings would have found AIM of what they should. Vectors that
lie in clusters need few blocks, however many they are; nearly uniform ones in many dimensions, where no ordering
tells near from far, need a share of all blocks that does not fall.

Inner products become angles by one more coordinate that gives all candidates the largest norm. Of equal vectors only
the first k + 1 ids can be among a query's k nearest, so a vector that very many rows share fills no block; queries
with equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise

CURVES = 12
DIMENSIONS = 8  # of a projection
BITS = 4  # of a projected coordinate
BLOCK = 1024
PILOT = 250  # queries that are compared with all vectors, at most
AIM = 0.93  # the share of their true neighbours that the blocks must hold


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with integer coordinates under 2 ** bits, one row a point."""
    x = x.astype(np.uint64).copy()
    n, dims = x.shape
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:  # from the axes to the transposed index: undo the curve's reflections and exchanges
        low = q - one
        for i in range(dims):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= low
            swap = (x[:, 0] ^ x[:, i]) & low
            swap[high] = 0
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip, q = np.zeros(n, dtype=np.uint64), np.uint64(1 << (bits - 1))
    while q > one:
        flip[(x[:, dims - 1] & q) != 0] ^= q - one
        q >>= one
    x ^= flip[:, None]
    key = np.zeros(n, dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


def curve_keys(vectors: np.ndarray, largest: float, query: bool, curves: int = CURVES, seed: int = 3) -> np.ndarray:
    """A key for each vector and curve. Candidates get a last coordinate that brings them to the largest norm, queries are scaled to it."""
    rng = np.random.default_rng(seed)
    norm = np.sqrt((vectors**2).sum(axis=1))
    if query:
        unit = np.column_stack((vectors / norm[:, None], np.zeros(len(vectors))))
    else:
        unit = np.column_stack((vectors / largest, np.sqrt(np.maximum(0.0, 1 - (norm / largest) ** 2))))
    dims = unit.shape[1]
    each = min(DIMENSIONS, dims)
    keys = []
    for c in range(curves):
        if c % max(1, dims // each) == 0:  # disjoint directions as long as there are any, then another rotation
            rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        at = c % max(1, dims // each) * each
        shift = rng.uniform(-0.25, 0.25, each)
        y = unit @ rotation[:, at : at + each] * (np.sqrt(dims) / 2.5)
        cells = np.clip((y + 1 + shift) / 2, 0, 1 - 1e-9) * (1 << BITS)
        keys.append(hilbert_key(cells.astype(np.int64), BITS).view(np.int64))
    return np.column_stack(keys)


def _valid(vector: Column) -> Column:
    """Finite, not null, not zero and without null components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keyed(rows: DataFrame, largest: float, curves: int) -> DataFrame:
    """rows (_id, _query, _v) once for each curve, as _curve, _key, _id, _query, _v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, query = _stack(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
            keys = np.empty((len(v), curves), dtype=np.int64)
            for q in (True, False):
                if (query == q).any():
                    keys[query == q] = curve_keys(v[query == q], largest, q, curves)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * curves, pa.int32()), pa.array(keys.ravel()))], ["_id", "_query", "_v", "_keys"])

    made = rows.mapInArrow(run, f"_id long, _query boolean, _v {rows.schema['_v'].dataType.simpleString()}, _keys array<long>")
    return made.select("_id", "_query", "_v", F.posexplode("_keys").alias("_curve", "_key"))


def _blocked(rows: DataFrame, block: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """rows with _block: the ordering of each curve, range-partitioned and cut; blocks are numbered along the curve. Then the table that it reads."""
    kind = f"_id long, _query boolean, _v {rows.schema['_v'].dataType.simpleString()}, _curve int, _part int, _at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(3).to_numpy()
            at = np.empty(len(curve), dtype=np.int32)
            for c in np.unique(curve).tolist():
                own = curve == c
                at[own] = (seen.get(c, 0) + np.arange(own.sum())) // block
                seen[c] = seen.get(c, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(curve), part, dtype=np.int32)), pa.array(at)], ["_id", "_query", "_v", "_curve", "_part", "_at"])

    ranged = rows.repartitionByRange(parts, "_curve", "_key", "_id").sortWithinPartitions("_curve", "_key", "_id")
    made = materialise(ranged.select("_id", "_query", "_v", "_curve").mapInArrow(run, kind))
    runs = made.groupBy("_curve", "_part").agg((F.max("_at") + 1).alias("_n"))
    before = Window.partitionBy("_curve").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_curve", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row for each curve and partition
    return made.join(runs, ["_curve", "_part"]).select("_id", "_query", "_v", "_curve", (F.col("_before") + F.col("_at")).alias("_block")), made


def _compared(rows: DataFrame, k: int, width: int) -> DataFrame:
    """_query_id, _found (array of _s, _id): the k nearest in each block that a query meets."""
    near = rows.where("_query").withColumn("_block", F.explode(F.sequence(F.col("_block") - width, F.col("_block") + width)))
    rows = rows.where("not _query").unionByName(near).select("_id", "_query", "_v", "_curve", "_block")
    rows = rows.repartition("_curve", "_block").sortWithinPartitions("_curve", "_block", "_query", "_id")
    item = pa.list_(pa.struct([("_s", pa.float64()), ("_id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(ids: np.ndarray, query: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            cand, cand_ids, asked, asked_ids = v[~query], ids[~query], v[query], ids[query]
            out: tuple[list, list] = ([], [])
            for start in range(0, len(asked) if len(cand) else 0, 256):
                some = asked[start : start + 256]
                scores = some @ cand.T
                top = np.partition(scores, max(0, len(cand) - k), axis=1)[:, max(0, len(cand) - k)]
                for i in range(len(some)):
                    at = np.flatnonzero(scores[i] >= top[i] - 1e-9)
                    exact = (cand[at] * some[i]).sum(axis=1)
                    best = np.lexsort((cand_ids[at], -exact))[:k]
                    out[0].append(int(asked_ids[start + i]))
                    out[1].append([{"_s": -s, "_id": x} for s, x in zip(exact[best].tolist(), cand_ids[at][best].tolist(), strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], item)], ["_query_id", "_found"])

        key, parts = None, []
        for batch in batches:
            curve, block = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0)) + 1
            v, ids, query = _stack(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if (curve[a], block[a]) != key and parts:
                    yield solved(*[np.concatenate(x) for x in zip(*parts, strict=True)])
                    parts = []
                key = (curve[a], block[a])
                parts.append((ids[a:b], query[a:b], v[a:b]))
        if parts:
            yield solved(*[np.concatenate(x) for x in zip(*parts, strict=True)])

    return rows.mapInArrow(run, "_query_id long, _found array<struct<_s:double,_id:bigint>>")


def _nearest(cands: DataFrame, asked: DataFrame, k: int) -> dict[int, list[int]]:
    """For each of the few rows of ``asked`` (_class, _v) the ids of the k nearest of cands (_class, _id, _v) of another class, by comparing all."""
    few = asked.toArrow()
    ids, v = few.column(0).to_numpy(), _stack(few.column(1).combine_chunks())
    sent = cands.sparkSession.sparkContext.broadcast((ids, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = sent.value
        best, found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                scores = v @ _stack(batch.column(2)).T
                scores[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
                both = np.concatenate((best, scores), axis=1)
                of = np.concatenate((found, np.broadcast_to(batch.column(1).to_numpy(), scores.shape)), axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best, found = np.take_along_axis(both, top, 1), np.take_along_axis(of, top, 1)
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[real]), pa.array(found[real]), pa.array(best[real])], ["_q", "_id", "_s"])

    rows = cands.select("_class", "_id", "_v").mapInArrow(run, "_q long, _id long, _s double")
    # k rows of each query from each task
    rows = rows.groupBy("_q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), "_id"))), 1, k).alias("all"))
    return {r._q: [x._id for x in r["all"]] for r in rows.collect()}


def _width(blocked: DataFrame, nearest: dict[int, list[int]], aim: float) -> int:
    """The least number of blocks on each side that holds the share ``aim`` of the true neighbours."""
    queries, others = sorted(nearest), sorted({i for x in nearest.values() for i in x})
    spark = blocked.sparkSession
    wanted = spark.createDataFrame([(i, True) for i in queries] + [(i, False) for i in others], "_i long, _is boolean")  # PILOT * (k + 1) at most
    rows = blocked.join(F.broadcast(wanted), (F.col("_id") == F.col("_i")) & (F.col("_query") == F.col("_is"))).select("_query", "_id", "_curve", "_block").collect()
    at: tuple[dict, dict] = ({}, {})
    for r in rows:
        at[r._query].setdefault(r._id, {}).setdefault(r._curve, []).append(r._block)
    apart = []
    for q, found in nearest.items():
        for i in found:
            apart.append(min((abs(a - b) for c, blocks in at[1].get(q, {}).items() for a in blocks for b in at[0].get(i, {}).get(c, ())), default=0))
    return int(np.sort(apart)[max(0, int(np.ceil(aim * len(apart))) - 1)]) if apart else 0


def search(vectors: DataFrame, queries: Column, k: int = 20, curves: int = CURVES, block: int = BLOCK, pilot: int = PILOT, aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) for which ``queries`` is true, the k nearest found.

    Nearest is the largest inner product, in double precision; ties go to the smaller vec_id; a query's own row is no
    candidate. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of
    another length than most have (of equally common lengths, the larger), nor rows with a null vec_id. Rows of one
    vec_id and vector are one; those of one vec_id and several vectors are candidates each. Of vectors only vec_id,
    embedding and what ``queries`` names are read. No vectors, or no queries, give no rows.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("_id"), v.alias("_v"), F.coalesce(queries, F.lit(False)).alias("_q")).where(F.col("vec_id").isNotNull() & _valid(v))
    lengths = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("_v") == lengths.d)
    # equal vectors are one class; -0.0 and 0.0 are equal
    rows = rows.withColumn("_class", F.xxhash64(F.transform("_v", lambda x: x.cast("double") + F.lit(0.0))))
    norms = rows.agg(F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    order = F.row_number().over(Window.partitionBy("_class").orderBy("_id"))
    cands = rows.select("_class", "_id", "_v").dropDuplicates(["_class", "_id"]).withColumn("_n", order).where(F.col("_n") <= k + 1)
    asked = rows.where("_q").select(F.col("_id").alias("query_id"), "_class").distinct()
    one = rows.where("_q").groupBy("_class").agg(F.first("_v").alias("_v"))
    both = cands.select("_id", F.lit(False).alias("_query"), "_v").unionByName(one.select(F.col("_class").alias("_id"), F.lit(True).alias("_query"), "_v"))
    both, cands = materialise(both), materialise(cands)
    keyed = materialise(_keyed(both, float(np.sqrt(norms.m)), curves))
    discard(both)
    parts = int(min(2000, max(1, norms.n * curves // 40_000)))
    blocked, _ = _blocked(keyed, block, parts)
    discard(keyed)
    some = one.select("_class", "_v").orderBy(F.xxhash64("_class"), "_class").limit(pilot)
    width = _width(blocked, _nearest(cands, some, k), aim)
    discard(cands)
    compared = _compared(blocked, k + 1, width)
    # 2 * width + 1 blocks of each curve, k + 1 rows of each. A pair is met once on a curve at most, so k + 1 of them are
    # among the first (k + 1) * curves
    first = F.slice(F.array_sort(F.flatten(F.collect_list("_found"))), 1, (k + 1) * curves)
    merged = compared.groupBy("_query_id").agg(F.slice(F.array_distinct(first), 1, k + 1).alias("_found"))
    met = asked.join(merged, F.col("_class") == F.col("_query_id"))
    others = F.slice(F.filter("_found", lambda x: x["_id"] != F.col("query_id")), 1, k)
    met = met.select("query_id", F.posexplode(others).alias("_r", "_x"))
    return met.select("query_id", (F.col("_r") + 1).cast("int").alias("rank"), F.col("_x._id").alias("vec_id"), (-F.col("_x._s")).alias("score"))
