"""Near-duplicate detection with bottom-k sketches from one hash function.

Texts with the same set of shingles are one class, which the class's smallest doc_id stands for. Each class keeps the
smallest hashes of its shingles. The few smallest are looked up in inverted lists, rarest first: two sets over the
threshold share one of so many of their rarest values but for a chance under MISS. In a list, bottom-k sketches
estimate the overlap of two sets from the sketch of their union; pairs that may reach the threshold are confirmed on
the full sets, made anew from the texts.

No list is written out as pairs. A first pass links each class to the earliest alike class of every cluster in its
list, so its links grow with the list, not its square; a second pass looks, with the components known, at what is
still apart. Lists longer than BLOCK are cut in blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, texts

LOW = 12  # smallest hashes that a class has in inverted lists
SKETCH = 768  # smallest hashes in a sketch
MISS = 1e-8  # chance that two sets just at the threshold share no list
BLOCK = 4096  # classes of one list in one task, at most twice
HUB = 200  # pairs of one class that are confirmed together
_POWERS = np.concatenate(([np.uint64(1)], np.full(4095, 0x9E3779B97F4A7C15, dtype=np.uint64))).cumprod(dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_PIECE = 1 << 21


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word between white space, A-Z lower-cased."""
    made, at = [], 0
    while at < len(text):  # very long texts piece by piece, cut at white space
        end = at + _PIECE
        if end < len(text):
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
        made.append(_piece_hashes(np.frombuffer(text, dtype=np.uint8)[at:end]))
        at = end
    return np.concatenate(made) if made else np.zeros(0, dtype=np.uint64)


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    letters = _LOWER[raw[word]].astype(np.uint64) + np.uint64(1)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    power = _POWERS[place & 4095]
    if len(place) and place.max() > 4095:
        power = power * _mixed((place >> 12).astype(np.uint64) + np.uint64(1))
    return _mixed(np.add.reduceat(letters * power, first) + sizes.astype(np.uint64))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; the whole sequence is one where there are fewer words."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(width, len(w)), dtype=np.uint64)
    for i in range(min(width, len(w))):
        h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n])
    return np.unique(h)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed(threshold: float, low: int = LOW, miss: float = MISS) -> int:
    """The most values that two sketches of ``low`` values share but for a chance of ``miss``, at that similarity."""
    n, tail, c = low + 2, 0.0, 0
    while (tail := tail + math.comb(n, c) * threshold**c * (1 - threshold) ** (n - c)) <= miss:
        c += 1
    return max(1, c)


def row_key() -> Column:
    """What rows alike in doc_id and text have in common."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """_id, _row (row_key), _n (set size), _class (digest of the set), _low (smallest hashes), _sketch (upper halves of more), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, low, sketch = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text, width)
                size.append(len(s))
                digest.append(_digest(s))
                low.append(s[:LOW].view(np.int64))
                sketch.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["_id", "_row", "_n", "_class", "_low", "_sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), row_key().alias("_row"))
    return rows.mapInArrow(run, "_id long, _row long, _n long, _class binary, _low array<long>, _sketch binary")


def _lists(classes: DataFrame, threshold: float) -> DataFrame:
    """_value, _blocks, _rep: each class with the rarest of its low values, as far as others have them too."""
    share = needed(threshold)
    whole = int(LOW * threshold)  # a class so small meets only classes that are whole in their low values
    posted = classes.select("_rep", "_n", F.size("_low").alias("_of"), F.explode("_low").alias("_value"))
    shared = posted.groupBy("_value").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    found = posted.join(shared, "_value").groupBy("_rep", "_n", "_of").agg(F.sort_array(F.collect_list(F.struct("_df", "_value"))).alias("_all"))
    must = F.when(F.col("_n") <= whole, F.ceil(F.col("_n") * threshold - 1e-9)).otherwise(F.least(F.lit(share), F.col("_of")))
    # of the _of values, rarest first, the first (_of - must + 1) count; those that nobody shares come before all
    take = F.col("_of") - must + 1 - (F.col("_of") - F.size("_all"))
    found = found.select("_rep", F.explode(F.slice("_all", 1, F.greatest(take, F.lit(0)).cast("int"))).alias("_x"))
    return found.select("_rep", F.col("_x._value").alias("_value"), F.ceil(F.col("_x._df") / BLOCK).cast("int").alias("_blocks"))


def _pairs(lists: DataFrame, classes: DataFrame, threshold: float, second: bool) -> DataFrame:
    """_a, _b: the pairs to confirm. In the second pass classes have a component (_comp) and all pairs apart count."""
    own = F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64("_rep", F.lit(1)), F.col("_blocks"))).otherwise(F.lit(0)).cast("int")
    lists = lists.withColumn("_own", own)
    # a list in one block has the key (0, 0); else each class goes to all pairs of blocks that hold its own
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    lists = lists.withColumn("_other", other).select("_rep", "_value", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"))
    comp = F.col("_comp") if second else F.col("_rep")
    if second:  # lists that are all one component have nothing left to find
        known = lists.join(classes.select("_rep", "_comp"), "_rep")
        apart = known.groupBy("_value", "_p", "_q").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo <> _hi")
        lists = lists.join(apart.select("_value", "_p", "_q"), ["_value", "_p", "_q"], "left_semi")
    held = lists.join(classes.select("_rep", "_n", "_sketch", comp.alias("_c")), "_rep")
    held = held.repartition("_value", "_p", "_q").sortWithinPartitions("_value", "_p", "_q", "_rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, a, b = None, [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for value, p, q, rep, n, sketch, c in zip(*columns, strict=True):
                if (value, p, q) != key:
                    _alike(group, threshold, second, a, b)
                    key, group = (value, p, q), []
                group.append((rep, n, sketch, c))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["_a", "_b"])
                a, b = [], []
        _alike(group, threshold, second, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["_a", "_b"])

    return held.select("_value", "_p", "_q", "_rep", "_n", "_sketch", "_c").mapInArrow(run, "_a long, _b long").distinct()


def _alike(group: list[tuple], threshold: float, second: bool, a: list[int], b: list[int]) -> None:
    """Adds the pairs of one list that may reach the threshold."""
    if len(group) < 2 or second and len({g[3] for g in group}) < 2:
        return
    ids = [g[0] for g in group]
    n = np.array([g[1] for g in group])
    sketches = [np.frombuffer(g[2], dtype=np.uint32) for g in group]
    comp = np.unique([g[3] for g in group], return_inverse=True)[1]
    sizes = np.array([len(s) for s in sketches])
    whole = n <= SKETCH
    last = np.where(whole, np.uint32(0xFFFFFFFF), np.array([s[-1] for s in sketches]))
    flat, of = np.concatenate(sketches), np.repeat(np.arange(len(group)), sizes)
    order = np.argsort(flat, kind="stable")
    values, owners = flat[order], of[order]
    left, right = np.searchsorted(values, flat, "left"), np.searchsorted(values, flat, "right")
    starts = np.concatenate(([0], np.cumsum(sizes)))
    cluster = np.arange(len(group))  # first pass: clusters of what was linked in this list

    for x in range(1, len(group)):
        lo, hi = left[starts[x] : starts[x + 1]], right[starts[x] : starts[x + 1]]
        many = hi - lo
        met = owners[np.repeat(hi - np.cumsum(many), many) + np.arange(many.sum())]
        both = np.bincount(met, minlength=len(group))[:x]
        near = np.flatnonzero((both > 0) & (np.minimum(n[:x], n[x]) >= threshold * np.maximum(n[:x], n[x]) - 1e-9))
        if second:
            near = near[comp[near] != comp[x]]
        if not len(near):
            continue
        top = np.minimum(last[near], last[x])
        mine = np.searchsorted(sketches[x], top, "right")
        its = np.array([sizes[y] if last[y] <= t else np.searchsorted(sketches[y], t, "right") for y, t in zip(near, top, strict=True)])
        union = np.maximum(1, mine + its - both[near])
        estimate = both[near] / union
        exact = whole[near] & whole[x]
        # upper halves of hashes: an equal pair or two may be none
        slack = np.where(exact, 2 / union, 6 * np.sqrt(threshold * (1 - threshold) / union))
        if second:
            for y in near[estimate >= threshold - slack]:
                a.append(ids[y]), b.append(ids[x])
            continue
        for y in near[estimate >= threshold]:
            if cluster[y] != cluster[x]:
                a.append(ids[y]), b.append(ids[x])
                cluster[cluster == cluster[x]] = cluster[y]


def _class_texts(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """_rep, _text: one text of each class in the pairs. A doc_id may have several texts, so digests are made anew."""
    ends = pairs.select(F.col("_a").alias("_rep")).union(pairs.select("_b")).distinct()
    ids = classes.join(ends, "_rep", "left_semi").select("_least", "_class")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(ids, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_digest(shingles(t, width)) for t in texts(batch.column(1))], pa.binary()), batch.column(1)], ["_class", "_text"])

    rows = rows.mapInArrow(run, "_class binary, _text string")
    return rows.join(ids, "_class", "left_semi").groupBy(F.xxhash64("_class").alias("_rep")).agg(F.min("_text").alias("_text"))


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets, which come from the texts; written."""
    held = materialise(_class_texts(docs, pairs, classes, width))
    one, two = held.select(F.col("_rep").alias("_a"), F.col("_text").alias("_s")), held.select(F.col("_rep").alias("_b"), F.col("_text").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            ok = []
            for a, s, t in zip(batch.column(0).to_pylist(), texts(batch.column(2)), texts(batch.column(3)), strict=True):
                if a != last:  # many in a row have one _a
                    last, x = a, shingles(s, width)
                y = shingles(t, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_a", "_b"]).filter(pa.array(ok, pa.bool_()))

    # a class with very many pairs is dealt out, and its text sent once to each of its tasks
    hubs = pairs.groupBy("_a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("_of")).where("_of > 1")
    of = F.coalesce("_of", F.lit(1))
    dealt = pairs.join(hubs, "_a", "left").select("_a", "_b", F.pmod(F.xxhash64("_b"), of).cast("int").alias("_salt"))
    one = one.join(hubs, "_a", "left").select("_a", "_s", F.explode(F.sequence(F.lit(0), of - 1)).alias("_salt"))
    made = materialise(dealt.join(two, "_b").join(one, ["_a", "_salt"]).select("_a", "_b", "_s", "_t").mapInArrow(run, "_a long, _b long"))
    discard(held)
    return made


def components(links: DataFrame) -> DataFrame:
    """_node, _comp: the smallest node that each node of the links (_a, _b) reaches.

    Every node takes its neighbours' smallest label, then its label's label, until nothing changes; each round is a
    table in the shared folder, and nothing but a count reaches the driver.
    """
    both = materialise(links.select("_a", "_b").union(links.select("_b", "_a")).distinct())
    labels = materialise(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_b"), F.min("_a")).alias("_comp")))
    while True:
        near = both.join(labels.select(F.col("_node").alias("_b"), "_comp"), "_b").groupBy(F.col("_a").alias("_node")).agg(F.min("_comp").alias("_m"))
        step = labels.join(near, "_node").select("_node", F.col("_comp").alias("_was"), F.least("_comp", "_m").alias("_comp"))
        jump = labels.select(F.col("_node").alias("_comp"), F.col("_comp").alias("_j"))
        step = materialise(step.join(jump, "_comp", "left").select("_node", "_was", F.least("_comp", "_j").alias("_comp")))
        discard(labels)
        labels = step
        if not step.where("_comp <> _was").limit(1).count():
            discard(both)
            return labels.select("_node", "_comp")


def _with_component(classes: DataFrame, comps: DataFrame) -> DataFrame:
    found = classes.join(comps, F.col("_rep") == F.col("_node"), "left")
    return found.withColumn("_comp", F.coalesce("_comp", "_rep")).drop("_node")


def classify(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_key: one row for each row of docs (doc_id, text).

    Two texts are linked if their sets of ``width``-word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach, kept says that it is the row's own. A null text, or one
    without words, has an empty set and is linked with nothing. A text of fewer words has one shingle, all of it. A
    repeated row is a document like another: rows of one doc_id and text all have the same result. A null doc_id
    belongs to its class like any other but stands for it, as null, only where no row has an id. Where one doc_id has
    several texts, each text has its own result.
    """
    threshold = percent / 100
    sketched = materialise(_sketched(docs, width))
    grown = sketched.where("_n > 0").groupBy("_class").agg(F.min("_id").alias("_least"), F.first("_n").alias("_n"), F.first("_low").alias("_low"), F.first("_sketch").alias("_sketch"))
    # the key of a class is a hash of its digest, so that rows which share a doc_id stay apart
    classes = materialise(grown.withColumn("_rep", F.xxhash64("_class")))
    rows = materialise(sketched.select("_id", "_row", "_n", "_class"))
    discard(sketched)
    lists = materialise(_lists(classes, threshold))
    first = materialise(_pairs(lists, classes, threshold, False))
    links = _confirmed(first, docs, classes, width, percent)
    comps = components(links)
    rest = materialise(_pairs(lists, _with_component(classes, comps), threshold, True).join(first, ["_a", "_b"], "left_anti"))
    more = _confirmed(rest, docs, classes, width, percent)
    after = materialise(_with_component(classes.select("_rep", "_class", "_least"), components(links.union(more))))
    discard(classes, lists, first, links, comps, rest, more)
    least = after.groupBy("_comp").agg(F.min("_least").alias("component_id"))
    ends = after.join(least, "_comp").select("_class", "component_id", F.lit(True).alias("_in"))
    made = rows.join(ends, "_class", "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("_id"))
    return made.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"), F.col("_row").alias("row_key"))
