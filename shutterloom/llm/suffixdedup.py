"""Removal of long byte strings that stand more than once, with suffix arrays built by linear grouping.

Where equal strings may be is found by content: each window of PASSAGE bytes has as anchor the place of its smallest
GRAM-byte hash, so equal windows have equal anchors at the same offset, and a longer string is met at the anchor of its
first window. Anchors whose hash stands only once in the corpus are dropped. The others bring their context, all that
the windows they anchor go on with, to the task that has their hash. There, what follows and, reversed, what precedes
each anchor is cut into blocks, and one suffix array of all of them, made by grouping suffixes by their Lyndon prefixes,
orders the contexts. The common prefixes along the two orders tell how far any two contexts agree around the anchor,
and so which strings of LENGTH bytes, and of PASSAGE bytes, start elsewhere too.

Exact copies of a text are one class first: a class of two or more is removed whole, and stands in as one text for
the others. Anchors with more than CROWD contexts do not meet in one task; their windows are counted by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, texts

LENGTH = 400
PASSAGE = 250  # fifty words of four letters
GRAM = 16
CROWD = 20_000
_BLOCK = 80  # bytes of a symbol in the suffix arrays
_CHUNK = 8_000  # contexts in one suffix array
_PIECE = 1 << 22
#: Groups up to this size are judged by all common lengths along the orders, larger ones offset by offset.
_SMALL = 256
#: Anchors fall in so many buckets; those of a bucket with many times the mean are dealt out over SALTS tasks.
_BUCKETS, _HOT, _SALTS = 65_536, 8, 64


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol is smaller than all others, in linear time but for small sorts.

    First all suffixes are grouped by Lyndon prefix. Groups are taken from the highest down. A suffix of the group
    points to the nearest one before it that is in a lower group; a suffix that k of the group point to goes on with
    k times the group's prefix, so it leaves its own group for one just above it, the higher the larger k. Then the
    order in each group follows from that of the suffixes after their Lyndon prefixes: from the smallest suffix up,
    each one places those whose prefix ends where it begins, which its predecessor and that one's pointers name.
    """
    n = len(s)
    if n < 2:
        return list(range(n))
    symbols = sorted(set(s))
    rank = {x: i for i, x in enumerate(symbols)}
    group = [rank[x] for x in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))  # the groups as a list, from the highest down
    above = [*range(1, len(symbols)), -1]
    done = bytearray(n)
    pointer = [-1] * n
    ordered: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        counts: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = pointer[p]
            if p >= 0:
                if group[p] == g:
                    p = pointer[p]
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            pointer[i] = p
        for i in own:
            done[i] = 1
        members[g] = own
        ordered.append(own)
        if counts:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in counts.items():
                split.setdefault((group[p], k), []).append(p)
            for old, k in sorted(split, reverse=True):  # the largest k of a group first: each goes just above the old one
                part = split[old, k]
                if len(part) > 1:
                    part.sort()
                new = len(members)
                members.append(part)
                for p in part:
                    group[p] = new
                up = above[old]
                below.append(old), above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]

    free, at = [0] * len(members), 0
    for own in reversed(ordered):
        if own:
            free[group[own[0]]] = at
            at += len(own)
    made, placed = [-1] * n, bytearray(n)
    made[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = made[r] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            made[free[g]] = j
            free[g] += 1
            j = pointer[j]
    return made


def _grams(raw: np.ndarray) -> np.ndarray:
    h = raw.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4, 8):
        h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64) | 1) + h[step:]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(text: bytes, length: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor its hash, place, and the first and last start of the windows that it anchors (leftmost of ties)."""
    wide, parts, raw = length - GRAM + 1, [], np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(raw) - length + 1, _PIECE):  # very long texts piece by piece
        h = _grams(raw[at : at + _PIECE + length - 1])
        starts, bits = len(h) - wide + 1, np.uint64(len(h).bit_length())
        # a place under the upper bits of its hash: the least is the leftmost of the smallest
        marked = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        rows = np.concatenate((marked, np.full(-len(h) % wide, np.uint64(2**64 - 1)))).reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts])
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        place = (least[lo] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        parts.append((h[place], place + at, lo + at, np.concatenate((lo[1:], [starts])) - 1 + at))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    h, place, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    # an anchor on both sides of a cut is one
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return h[new], place[new], lo[new], hi[np.concatenate((new[1:], [len(place)])) - 1]


def _anchored(rows: DataFrame, passage: int) -> DataFrame:
    """_id, _key, _bytes, _sha (SHA-256 of the text) and _hashes (of its anchors, one of several places twice) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, found = [], [], []
            for text in texts(batch.column(2)):
                size.append(len(text))
                digest.append(hashlib.sha256(text).digest())
                once, n = np.unique(anchors(text, passage)[0].view(np.int64), return_counts=True)
                found.append(np.concatenate((once, once[n > 1])))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["_id", "_key", "_bytes", "_sha", "_hashes"])

    return rows.select("_id", "_key", "_text").mapInArrow(run, "_id long, _key long, _bytes long, _sha binary, _hashes array<long>")


def _shared(places: DataFrame) -> DataFrame:
    """places (_class, _key, _h) with _df, the number of rows that their anchor has, where it is over 1.

    A very common anchor would bring all its rows to one task; so buckets of anchors that hold far more rows than the
    mean, at most _BUCKETS / _HOT of them, are dealt out by text.
    """
    bucket = F.pmod("_h", F.lit(_BUCKETS))
    counts = places.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_n")).first()._n or 0
    hot = F.broadcast(counts.where((F.col("_n") > 1000 * _HOT) & (F.col("_n") > _HOT * total / _BUCKETS)).select("_bucket", F.lit(_SALTS).alias("_of")))
    of = F.coalesce("_of", F.lit(1))
    df = places.groupBy("_h").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1").withColumn("_bucket", bucket)
    df = df.join(hot, "_bucket", "left").select("_h", "_df", F.explode(F.sequence(F.lit(0), of - 1)).alias("_salt"))
    dealt = places.withColumn("_bucket", bucket).join(hot, "_bucket", "left").select("_class", "_key", "_h", F.pmod(F.xxhash64("_class"), of).cast("int").alias("_salt"))
    return dealt.join(df, ["_h", "_salt"]).select("_class", "_key", "_h", "_df")


def _contexts(held: DataFrame, length: int, passage: int) -> DataFrame:
    """_h, _class, _key, _p (places), _at (anchor's place in the context), _context, for _class, _key, _text and the wanted _hashes.

    Alike contexts of one text are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                rows: list[tuple] = []
                for cls, key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    seen: dict[tuple[int, bytes, int], list[int]] = {}
                    h, p, lo, hi = anchors(text, passage)
                    h = h.view(np.int64)
                    own = np.isin(h, np.array(wanted, dtype=np.int64))
                    for x, at, a, b in zip(h[own].tolist(), p[own].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True):
                        seen.setdefault((x, text[a : b + length], at - a), []).append(at)
                    rows += [(x, cls, key, ps, at, context) for (x, context, at), ps in seen.items()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_h", "_class", "_key", "_p", "_at", "_context"])

    return held.mapInArrow(run, "_h long, _class binary, _key long, _p array<long>, _at int, _context binary")


def _orders(sides: list[list[bytes]]) -> list[np.ndarray]:
    """The rank of each string of each side, by one suffix array over all of their blocks."""
    flat = [x for side in sides for x in side]
    lengths = np.array([len(x) for x in flat])
    sizes = -(-lengths // _BLOCK)
    blocks = np.frombuffer(b"".join(x.ljust(n * _BLOCK, b"\0") for x, n in zip(flat, sizes.tolist(), strict=True)), dtype=">u8").reshape(-1, _BLOCK // 8)
    ends = np.cumsum(sizes)
    filled = np.full(len(blocks), _BLOCK)  # bytes in a block, which tell a zero byte from none
    filled[ends[sizes > 0] - 1] = (lengths - (sizes - 1) * _BLOCK)[sizes > 0]
    order = np.lexsort((filled, *blocks.T[::-1])) if len(blocks) else np.zeros(0, dtype=np.int64)
    ranks = np.empty(len(blocks), dtype=np.int64)
    if len(blocks):
        other = (blocks[order][1:] != blocks[order][:-1]).any(axis=1) | (filled[order][1:] != filled[order][:-1])
        ranks[order] = np.concatenate(([0], np.cumsum(other))) + 2
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    s = np.ones(int(sizes.sum()) + len(flat) + 1, dtype=np.int64)  # 1 ends a string
    inner = np.ones(len(s), dtype=bool)
    inner[starts + sizes] = False
    inner[-1] = False
    s[inner] = ranks
    s[-1] = 0
    place = np.empty(len(s), dtype=np.int64)
    place[suffix_array(s.tolist())] = np.arange(len(s))
    made, at = [], 0
    for side in sides:
        made.append(place[starts[at : at + len(side)]])
        at += len(side)
    return made


def _common(rows: list[bytes], order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Along the order, how long a prefix each string has in common with the one before; -1 at a new group."""
    lengths = np.array([len(x) for x in rows])[order]
    width = max(1, int(lengths.max()))
    matrix = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in order.tolist()), dtype=np.uint8).reshape(-1, width)
    other = matrix[1:] != matrix[:-1]
    same = np.where(other.any(axis=1), other.argmax(axis=1), width)
    same = np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))
    return np.concatenate(([-1], np.where(group[order][1:] == group[order][:-1], same, -1)))


def _between(common: np.ndarray) -> np.ndarray:
    """For rows of common prefixes along an order (0 before the first), what each two of n strings have in common: rows x n x n."""
    g, n = common.shape
    made = np.full((g, n, n), -1, dtype=np.int16)
    for a in range(n - 1):
        made[:, a, a + 1 :] = np.minimum.accumulate(common[:, a + 1 :], axis=1)
    return np.maximum(made, made.transpose(0, 2, 1))


def repeated(contexts: list[tuple[int, int, bytes, bool]], lengths: tuple[int, ...] = (LENGTH,)) -> np.ndarray:
    """lengths x contexts x 2: how many bytes before and from the anchor on lie in strings of that length that stand twice, or -1.

    Contexts are (group, anchor's place, bytes, known to stand twice), those of a group one after another.
    """
    group = np.unique([c[0] for c in contexts], return_inverse=True)[1]
    right = [c[2][c[1] :] for c in contexts]
    left = [c[2][: c[1]][::-1] for c in contexts]
    before, after = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    twice = np.array([c[3] for c in contexts])
    ranks = _orders([right, left])
    by_right, by_left = np.lexsort((ranks[0], group)), np.lexsort((ranks[1], group))
    right_common, left_common = _common(right, by_right, group), _common(left, by_left, group)
    made = np.full((len(lengths), len(contexts), 2), -1)
    sizes = np.bincount(group)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for n in np.unique(sizes[sizes <= _SMALL]).tolist():
        some = starts[sizes == n]
        for first in range(0, len(some), max(1, 4_000_000 // (n * n))):
            at = some[first : first + max(1, 4_000_000 // (n * n)), None] + np.arange(n)
            r, m = _between(right_common[at]), _between(left_common[at])
            ids = by_right[at]
            # the contexts' places in the left order, taken in the right one
            seat = np.empty(len(contexts), dtype=np.int64)
            seat[by_left[at].ravel()] = np.tile(np.arange(n), len(at))
            s, g = seat[ids], np.arange(len(at))
            m = m[g[:, None, None], s[:, :, None], s[:, None, :]]
            own = np.arange(n)
            r[:, own, own] = np.where(twice[ids], after[ids], -1)
            m[:, own, own] = np.where(twice[ids], before[ids], -1)
            both = m + r
            for i, length in enumerate(lengths):
                ok = (both >= length) & (m >= 0) & (r >= 0)
                made[i, ids.ravel(), 0] = np.where(ok, m, -1).max(axis=2).ravel()
                made[i, ids.ravel(), 1] = np.where(ok, r, -1).max(axis=2).ravel()
    large = np.flatnonzero(sizes[group] > _SMALL)
    if len(large):
        cls_right, cls_left = np.empty(len(contexts), dtype=np.int64), np.empty(len(contexts), dtype=np.int64)
        for d in range(int(before[large].max()) + 1):
            cls_left[by_left] = np.cumsum(left_common < d)
            for i, length in enumerate(lengths):
                has = large[(d <= before[large]) & (length - d <= after[large])]
                if not len(has):
                    continue
                cls_right[by_right] = np.cumsum(right_common < length - d)
                _, to, n = np.unique(cls_right[has] * (len(contexts) + 1) + cls_left[has], return_inverse=True, return_counts=True)
                hit = has[(n[to] > 1) | twice[has]]
                made[i, hit, 0] = d
                made[i, hit, 1] = np.maximum(made[i, hit, 1], length - d)
    return made


_CUTS = "_class binary, _key long, _from long, _to long, _short boolean"


def _in_groups(contexts: DataFrame, length: int, passage: int) -> DataFrame:
    """_class, _key, _from, _to, _short: the bytes that each context has in strings that stand twice, of length or (_short) passage bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> pa.RecordBatch:
            # contexts that are alike in several texts are judged once, as standing twice
            alike: dict[tuple[int, int, bytes], int] = {}
            times: list[int] = []
            of = []
            for row in rows:
                of.append(alike.setdefault((row[0], row[4], row[5]), len(times)))
                if of[-1] == len(times):
                    times.append(0)
                times[of[-1]] += len(row[3])
            found = repeated([(*c, n > 1) for c, n in zip(alike, times, strict=True)], (length, passage)).tolist() if rows else [[], []]
            made = [(row[1], row[2], p - a, p + b, short) for short, x in zip((False, True), found, strict=True) for row, (a, b) in zip(rows, map(x.__getitem__, of), strict=True) if b >= 0 for p in row[3]]
            columns = list(zip(*made, strict=True)) if made else [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_class", "_key", "_from", "_to", "_short"])

        rows: list[tuple] = []
        cut, seen = 0, set()  # where the last group begins, and its texts and places: a repeated row brings them again
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                    if rows and row[0] != rows[-1][0]:
                        if len(rows) - cut == 1 and len(rows[-1][3]) == 1:
                            rows.pop()  # a group of one context, once in its text, has nothing twice
                        if len(rows) >= _CHUNK:
                            yield solved(rows)
                            rows = []
                        cut, seen = len(rows), set()
                    if (mark := (row[1], row[3][0])) not in seen:
                        seen.add(mark)
                        rows.append(row)
        yield solved(rows)

    return contexts.repartition("_h").sortWithinPartitions("_h").mapInArrow(run, _CUTS)


def _by_hash(contexts: DataFrame, length: int, passage: int) -> DataFrame:
    """The same for anchors with very many contexts: all their windows, by hash of content, in a grouping."""
    rows = contexts.withColumn("_first", F.get("_p", F.lit(0))).withColumn("_size", F.length("_context"))
    # of each length, the windows that hold the anchor
    spans = lambda n: F.when(F.col("_size") >= n, F.transform(F.sequence(F.lit(0), F.least(F.col("_size") - n, F.col("_at"))), lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"))))
    none = F.array().cast("array<struct<s:int,n:int>>")
    rows = rows.select("_h", "_class", "_key", "_p", "_first", "_at", "_context", F.explode(F.concat(*[F.coalesce(spans(n), none) for n in dict.fromkeys((length, passage))])).alias("_x"))
    window = F.expr("substring(_context, _x.s + 1, _x.n)")
    mark = F.substring(F.unhex(F.sha2(window, 256)), 1, 16)
    rows = rows.select("_class", "_key", "_p", "_first", F.col("_x.n").alias("_n"), (F.col("_at") - F.col("_x.s")).alias("_d"), mark.alias("_w"))
    # windows by content and the anchor's place in them; a repeated row brings the same places again
    count = rows.groupBy("_w", "_n", "_d", "_class", "_first").agg(F.first(F.size("_p")).alias("_c")).groupBy("_w", "_n", "_d").agg(F.sum("_c").alias("_c"))
    found = rows.join(count.where("_c > 1").select("_w", "_n", "_d"), ["_w", "_n", "_d"], "left_semi").select("_class", "_key", F.explode("_p").alias("_x"), "_n", "_d")
    made = found.groupBy("_class", "_key", "_x", "_n").agg(F.max("_d").alias("_hi"), F.min("_d").alias("_lo"))
    return made.select("_class", "_key", (F.col("_x") - F.col("_hi")).alias("_from"), (F.col("_x") - F.col("_lo") + F.col("_n")).alias("_to"), (F.col("_n") != length).alias("_short"))


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (from, to) in order, those that meet or overlap as one."""
    made: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if made and a <= made[-1][1]:
            made[-1] = made[-1][0], max(b, made[-1][1])
        else:
            made.append((a, b))
    return made


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans, which are in order and apart."""
    ends = [0, *[b for _, b in spans]]
    return b"".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(text)], strict=True))


def _cut(held: DataFrame) -> DataFrame:
    """_class, _spans (array of from, to), _repeated, _hash (of what is left) from _class, _text and _cuts (array of _from, _to, _short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, short, hashes = [], [], []
            for text, cuts in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found = merged([(c["_from"], c["_to"]) for c in cuts if not c["_short"]])
                spans.append([{"start": a, "end": b} for a, b in found])
                short.append(sum(b - a for a, b in merged([(c["_from"], c["_to"]) for c in cuts])))
                hashes.append(hashlib.sha256(kept(text, found)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(short, pa.int64()), pa.array(hashes, pa.string())], ["_class", "_spans", "_repeated", "_hash"])

    return held.mapInArrow(run, "_class binary, _spans array<struct<start:long,end:long>>, _repeated long, _hash string")


def find(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans, n_repeated, kept_sha256, row_key: one row for each row of docs (doc_id, text).

    ``spans`` are the maximal runs (start, end, in bytes) under a ``length``-byte string that starts elsewhere too, in
    this text or another; strings are judged on the input. kept_sha256 is of the bytes outside them. n_repeated counts
    the bytes under such a string of ``passage`` bytes (at most ``length``). A null text is empty, and texts shorter
    than the strings have none. Repeated rows are copies like others, also where they share a doc_id; a null doc_id
    stays null. row_key is what rows alike in doc_id and text have in common. Of docs only these two columns are read.
    """
    passage = min(length, passage)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_id", "_text"))
    found = materialise(_anchored(rows, passage))
    kinds = found.withColumn("_class", F.substring("_sha", 1, 16))
    sizes = kinds.groupBy("_class").agg(F.count(F.lit(1)).alias("_copies"), F.min("_key").alias("_key"), F.first("_hashes").alias("_hashes"))
    # counted by text, so that copies do not make an anchor common
    places = materialise(sizes.where("size(_hashes) > 0").select("_class", "_key", F.explode("_hashes").alias("_h")))
    of = lambda test: F.array_distinct(F.collect_list(F.when(test, F.col("_h"))))
    # a text's anchors come back to it: some of its length divided by half of passage
    wanted = materialise(_shared(places).groupBy("_class", "_key").agg(of(F.col("_df") <= crowd).alias("_near"), of(F.col("_df") > crowd).alias("_crowded")))
    discard(places)
    # the same exchange of texts, by key, serves the contexts and the cuts
    text = rows.select("_key", "_text")
    own = F.substring(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)), 1, 16) == F.col("_class")  # keys are shorter than digests
    held = text.join(wanted.hint("shuffle_hash"), "_key").where(own)
    cuts = _in_groups(_contexts(held.where("size(_near) > 0").select("_class", "_key", "_text", "_near"), length, passage), length, passage)
    if wanted.where("size(_crowded) > 0").limit(1).count():
        cuts = cuts.union(_by_hash(_contexts(held.where("size(_crowded) > 0").select("_class", "_key", "_text", "_crowded"), length, passage), length, passage))
    cuts = cuts.groupBy("_class", "_key").agg(F.collect_list(F.struct("_from", "_to", "_short")).alias("_cuts"))
    made = materialise(_cut(text.join(cuts.hint("shuffle_hash"), "_key").where(own).select("_class", "_text", "_cuts")).dropDuplicates(["_class"]))
    discard(wanted)
    copies = sizes.where("_copies > 1").select("_class", F.lit(True).alias("_twice"))
    result = kinds.select("_id", "_key", "_bytes", "_sha", "_class").join(copies, "_class", "left").join(made, "_class", "left")
    whole = lambda n: F.col("_twice") & (F.col("_bytes") >= n)
    none = F.array().cast("array<struct<start:long,end:long>>")
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_bytes").alias("end")))
    return result.select(
        F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), F.when(whole(length), every).otherwise(F.coalesce("_spans", none)).alias("spans"),
        F.when(whole(passage), F.col("_bytes")).otherwise(F.coalesce("_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(whole(length), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_hash", F.lower(F.hex("_sha")))).alias("kept_sha256"),
        F.col("_key").alias("row_key"),
    )


def report(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated: find() in numbers, one row for each row of docs."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return find(docs, length, passage, crowd).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated")


def remove(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, crowd: int = CROWD) -> DataFrame:
    """docs, all columns and rows kept, with ``kept``: the bytes of the text that stay (a cut may go through a character).

    Null and empty texts keep nothing. A column named kept is replaced.
    """
    names = [c for c in docs.columns if c != "kept"]
    found = find(docs, length, passage, crowd).groupBy(F.col("row_key").alias("_key")).agg(F.first("spans").alias("_spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.col("doc_id").cast("long"), text).alias("_key")).join(found, "_key")
    raw = text.cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda x: x["end"]))
    starts = F.concat(F.transform("_spans", lambda x: x["start"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.hex(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in names], F.unhex(F.array_join(pieces, "")).alias("kept"))
