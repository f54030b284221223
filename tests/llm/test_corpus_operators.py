"""Operators across texts and vectors, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import ann, mixing, neardup, suffixdedup

from .test_text_operators import ODD, docs


def test_mixing_keeps_every_prefix_near_its_weights(spark):
    rows = [(5000 + i, "t", "en", "big" if i % 3 else f"s{i % 4}", 1) for i in range(1200)]
    weights = spark.createDataFrame([("big", 5.0), ("s0", 2.0), ("s1", 2.0), ("s2", 1.0), ("s3", 0.0), ("a", None), ("gone", -1.0)], "source string, weight double")
    got = mixing.mix(docs(spark, rows, True), weights, period=100, block_rows=4, chunk_rows=100).collect()
    assert len(got) == len(ODD) + 1200
    mixed = sorted((r.mix_order, r.source, r.mix_block, r.mix_release, r.mix_deadline) for r in got if r.mix_order is not None)
    assert len({x[0] for x in mixed}) == len(mixed) and {x[1] for x in mixed} == {"big", "s0", "s1", "s2"}
    share = {r.source_key[1:]: r.share / 100 for r in mixing.shares(weights, 100).collect()}
    slots = {o // 4: s for o, s, *_ in mixed}
    assert all(release <= o // 4 < deadline for o, _, _, release, deadline in mixed)
    sent, short = Counter(), min(max(t for t, s in slots.items() if s == x) for x in share)
    for t in range(short):
        sent[slots[t]] += 1
        assert all(abs(sent[s] - (t + 1) * share[s]) < 1 for s in share)
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    assert mixing.mix(docs(spark)).where("mix_order is null").count() == 0


@pytest.mark.parametrize("sources", [999, 1001, 8500])
def test_mixing_takes_any_number_of_sources(spark, sources):
    rows = [(i, f"s{i % sources}" if i % sources else None) for i in range(2 * sources)] + [(i, "s1") for i in range(2 * sources, 2 * sources + 500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=4)
    assert "Python" not in got._jdf.queryExecution().toString() and "InArrow" not in got._jdf.queryExecution().toString()
    got = got.collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows] and len({r.mix_order for r in got}) == len(rows)
    assert all(r.mix_release <= r.mix_order // 4 < r.mix_deadline for r in got)


def earliest_deadline_first(shares, period):
    """Slot by slot, all sources looked at each time."""
    sent, out = dict.fromkeys(shares, 0), []
    for slot in range(period):
        ready = [(-(-(sent[s] + 1) * period // e), s.encode()) for s, e in shares.items() if sent[s] < e and sent[s] * period // e <= slot]
        s = min(ready)[1].decode()
        out.append((slot, s, shares[s], sent[s]))
        sent[s] += 1
    return out


@pytest.mark.parametrize(("inner", "chunk", "period", "sources"), [(10, 1 << 16, 100, 5), (10, 1 << 16, 1, 1), (2, 4, 97, 40), (3, 8, 1000, 124), (10, 64, 1500, 187), (2, 8, 64, 64)])
def test_schedule_is_earliest_deadline_first(spark, monkeypatch, inner, chunk, period, sources):
    monkeypatch.setattr(mixing, "INNER", inner)
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rng = random.Random(period)
    names = ["n", "sé", *[f"s{i}" for i in range(sources)]][:sources]
    shares = dict.fromkeys(names, 1)
    for _ in range(period - sources):  # a third goes to one source, the rest as it falls
        shares[names[0] if rng.random() < 0.34 else rng.choice(names[: max(1, sources // 2)])] += 1
    shared = spark.createDataFrame(list(shares.items()), "source_key string, share int")
    got = sorted(map(tuple, mixing.schedule(shared, period).collect()))
    assert got == earliest_deadline_first(shares, period)


def test_mixing_equals_a_plain_schedule(spark):
    rows = [(i, f"s{min(i % 7, 3)}" if i % 5 else None) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    hashed = [(h % 2**64 // 2 % 18, h, d, s) for d, s, h in frame.select("doc_id", "source", F.xxhash64(F.lit(7), "doc_id")).collect()]  # 18 chunks
    shares = {r.source_key: r.share for r in mixing.shares(mixing.tempered_weights(frame), 50).collect()}
    assert sum(shares.values()) == 50
    queues = {}
    for *_, d, s in sorted(hashed):
        queues.setdefault("n" if s is None else "s" + s, []).append(d)
    want, turns = {}, earliest_deadline_first(shares, 50)
    for cycle in range(100):
        for slot, s, e, turn in turns:
            block = cycle * e + turn
            for i, d in enumerate(queues[s][block * 3 : block * 3 + 3]):
                want[d] = (block, block * 50 // e, -(-(block + 1) * 50 // e), (cycle * 50 + slot) * 3 + i)
    got = mixing.mix(frame, period=50, block_rows=3, chunk_rows=40).collect()
    assert {r.doc_id: (r.mix_block, r.mix_release, r.mix_deadline, r.mix_order) for r in got} == want and len(got) == 700


def test_too_short_a_period_is_refused(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    with pytest.raises(ValueError, match="2 sources"):
        mixing.shares(weights, 1)


def brute_groups(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sets, label


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 4096), (5, 80, 7)])
def test_near_duplicates(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # a small one: lists meet block by block
    monkeypatch.setattr(neardup, "HUB", max(2, block // 20))
    rng = random.Random(4)
    rows = []
    for g in range(8):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 60)) for _ in range(rng.choice([2, 6, 30, 90, 400]))]
        for _ in range(rng.choice([1, 5, 20])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 10**6))
            rows.append((6000 + len(rows), " ".join(w), "en", "s", 1))
    every = [(r[0], r[1]) for r in [*ODD, *rows]]
    sets, label = brute_groups(every, width, percent)
    least = {x: min((every[i][0] for i in range(len(every)) if label[i] == x and every[i][0] is not None), default=None) for x in label}
    want = sorted((e[0] or -1, len(sets[i]), (least[label[i]] if sets[i] else e[0]) or -1) for i, e in enumerate(every))
    got = neardup.classify(docs(spark, rows, True), width, percent).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert neardup.classify(docs(spark).limit(0)).count() == 0


def test_sketches_share_enough():
    """The share of pairs just at the threshold that have fewer common values than needed() says."""
    rng = np.random.default_rng(5)
    for threshold in (0.8, 0.85):
        few = 0
        for _ in range(4000):
            union = rng.random((300,)) < threshold
            side = rng.random(300) < 0.5
            x, y = np.flatnonzero(union | side)[: neardup.LOW], np.flatnonzero(union | ~side)[: neardup.LOW]
            few += len(np.intersect1d(x, y)) < neardup.needed(threshold)
        assert few == 0


def brute_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    made = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        made.append((len(t), sum(mask), (b"\0" + bytes(mask)).count(b"\0\1"), hashlib.sha256(kept).hexdigest(), kept))
    return made


@pytest.mark.parametrize(("crowd", "small"), [(20_000, 256), (20_000, 2), (2, 256)])
def test_suffix_dedup(spark, monkeypatch, crowd, small):
    monkeypatch.setattr(suffixdedup, "_SMALL", small)
    monkeypatch.setattr(suffixdedup, "_HOT", 0)
    rng = random.Random(6)
    word = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passages = [word(90) for _ in range(4)] + ["ab" * 400, "\0" * 450]
    texts = []
    for _ in range(30):
        texts.append(" ".join([word(rng.randint(0, 90)), *[rng.choice(passages)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 2))], word(rng.randint(0, 60))]))
    texts += [texts[0], texts[3], texts[3], "z" * 1200, "z" * 401, passages[0][:399], passages[1][:400]]
    rows = [(7000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    every = [*ODD, *rows]
    whole = [(r[1] or "").encode() for r in every]
    long, short = brute_removal(whole, 400), brute_removal(whole, 250)
    want = sorted((r[0] or -1, *x[:4], y[1]) for r, x, y in zip(every, long, short, strict=True))
    got = suffixdedup.report(docs(spark, rows, True), crowd=crowd).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in got) == want
    if crowd > 2 and small > 2:
        left = suffixdedup.remove(docs(spark, rows, True), crowd=crowd).collect()
        assert sorted((r.doc_id or -1, bytes(r.kept)) for r in left) == sorted((r[0] or -1, x[4]) for r, x in zip(every, long, strict=True))


def test_suffix_dedup_across_a_cut(spark):
    rng = np.random.default_rng(9)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    piece, size = suffixdedup._PIECE, 420
    passage = letters(size)
    # windows of the passage start on both sides of the cut; what stands around it differs
    texts = ["0" + letters(piece - 12) + "1" + passage + "2" + letters(2000), "3" + passage + "4"]
    got = {r.doc_id: r for r in suffixdedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        kept = text.replace(passage, "")
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (size, 1, hashlib.sha256(kept.encode()).hexdigest())


def test_suffix_dedup_of_nothing(spark):
    assert suffixdedup.report(docs(spark).limit(0)).count() == 0 and suffixdedup.report(docs(spark).where("length(text) < 100")).count() == 6


def test_suffix_array():
    rng = random.Random(7)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 16))] + [0]
        assert suffixdedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_neighbours_in_few_blocks(spark, spread):
    """Recall over 0.9 against brute force; of clustered vectors by looking at under a fifth of them."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    v = centres[rng.integers(0, 40, 4000)] + spread * rng.normal(size=(4000, 24)) * np.sqrt(24)
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    looked = []
    compared = ann._compared
    try:
        ann._compared = lambda rows, k, width: looked.append(width) or compared(rows, k, width)
        got = ann.search(df, F.col("vec_id") % 20 == 0, k=10, curves=6, block=32).collect()
    finally:
        ann._compared = compared
    found: dict[int, set] = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    hits = sum(len(found[q] & set(np.argsort(-s[q], kind="stable")[:10].tolist())) for q in range(0, 4000, 20))
    assert hits >= 0.9 * 10 * 200
    if spread < 0.1:
        assert (2 * looked[0] + 1) * 32 * 6 < 0.2 * 4000


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 16))
    v[1000:1600] = v[7]  # one vector for very many rows
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]), (9004, [float("nan")] * 16), (9005, [1.0]), (None, [1.0] * 16), (9006, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("_id", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 20 == 0, block=256).collect()
    by_query: dict[int, list] = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(3000), -np.round(s, 9))) if i != q][:20]
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        hits += len({r.vec_id for r in found} & set(order))
    assert hits >= 0.9 * 20 * len(by_query)
    same = sorted({r.vec_id for r in by_query[1000]} & {7, *range(1001, 1600)})
    assert same == [7, *range(1001, 1600)][: len(same)] and len(same) > 10
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    few = ann.search(df.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6



def test_hilbert_neighbours_differ_by_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = ann.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


