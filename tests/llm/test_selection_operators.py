"""Fill-in-middle, sharding and importance resampling, against plain versions on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import fim, resampling, sharding

from .test_text_operators import ODD, docs

CLASH = ("a.b", "_docs", "_hash", "_row", "_rank", "_text", "_id", "shard", "digest", "size", "place", "back`tick")


def clashing(spark, rows=()):
    return docs(spark, rows, True).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in CLASH})


def untouched(got):
    assert got and all(r[c] == f"{c}:{-1 if r.doc_id is None else r.doc_id}" for r in got for c in CLASH)


def hexdigits(key):
    return hashlib.sha256(key.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hexdigits(f"1:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, z = sorted(x % (len(w) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (w[:a], w[a:z], w[z:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts(seed, n):
    rng = random.Random(seed)
    signs = ["word", " ", "é", "😀", "\n", "\0", "<", "P", "S", "M", ">", "<P", "S>", "ſ", "9", " ", "￾"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_fim_equals_a_plain_version_and_comes_back(spark):
    rows = [(1000 + i, t, "en", "s", 1) for i, t in enumerate(odd_texts(3, 300) + ["has <M> inside", "x" * 20_000, "one two " * 5_000, None, ""])]
    rows += rows[:3] + [(None, "no id here at all", "en", "s", 1)]
    got = fim.transform(clashing(spark, rows)).withColumn("again", fim.restored(F.col("fim_form"), F.col("fim_output"))).collect()
    untouched(got)
    assert len(got) == len(rows) + len(ODD) and {r.fim_form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == plain_fim(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert fim.transform(docs(spark).limit(0)).count() == 0
    again = fim.transform(fim.transform(docs(spark, rows)))  # columns of those names are replaced
    assert sorted(again.columns) == sorted({*docs(spark).columns, *fim._MADE})


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_pieces_do_not_change_the_tokens(size):
    split = fim.Split(fim.Regex(fim.TOKEN), "isolated")
    for text in [*odd_texts(5, 200), "a" * 50 + " b", ""]:
        assert "".join(p for _, p in fim.pieces(text, size)) == text
        assert fim.offsets(split, text, size).tolist() == [m.start() for m in re.finditer("(?s)[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]


def least_maximum(sizes, shards):
    """The smallest largest shard over all ways to cut."""
    ways = itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1)
    return min(max(sum(sizes[a:z]) for a, z in itertools.pairwise([0, *w, len(sizes)])) for w in ways)


def test_walk_finds_the_minimax():
    rng = random.Random(1)
    for _ in range(150):
        sizes = [rng.choice([1, 2, 3, 5, 40, 90]) for _ in range(rng.randrange(1, 9))]
        shards, ends, whole = rng.randrange(1, 5), list(itertools.accumulate(sizes)), [True] * len(sizes)
        capacity = sharding.smallest(ends, whole, 1, shards, False)
        cuts = sharding.walk(ends, whole, capacity, shards, False)
        assert cuts[-1] == ends[-1] and len(cuts) <= shards
        assert max(z - a for a, z in itertools.pairwise([0, *cuts])) == least_maximum(sizes, shards)


def plain_shards(rows, shards):
    """shard by digest, by trying every capacity there can be."""
    sizes = Counter()
    for _, text, *_ in rows:
        sizes[hexdigits(text or "")] += len((text or "").encode()) + 1
    order = sorted(sizes)
    sums = list(itertools.accumulate(sizes[d] for d in order))
    for capacity in sorted({z - a for a, z in itertools.combinations([0, *sums], 2)}):
        of, shard, held = {}, 0, 0
        for d in order:
            if held and held + sizes[d] > capacity:
                shard, held = shard + 1, 0
            of[d], held = shard, held + sizes[d]
        if shard < shards:
            return of
    return {}


@pytest.mark.parametrize("hot, shards", [(0, 16), (200, 16), (3000, 5), (0, 2)])
def test_shards_equal_a_plain_version(spark, monkeypatch, hot, shards):
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "MORE", 1)
    rng = random.Random(hot + shards)
    rows = [(1000 + i, "w " * rng.randrange(40) + str(i % 90), "en", "s", 1) for i in range(150)] + [(5000 + i, "the same long text everywhere", "en", "s", 1) for i in range(hot)]
    rows += rows[:5] + [(None, "no id", "en", "s", 1), (None, None, "en", "s", 1)]
    table = clashing(spark, rows)
    got = sharding.assign(table, shards).collect()
    every = [(r.doc_id, r.text) for r in table.collect()]
    of = plain_shards(every, shards)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), of[hexdigits(t or "")]) for i, t in every)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_of_few_or_no_documents(spark, tmp_path):
    assert sharding.assign(docs(spark).limit(0)).count() == 0
    few = sharding.assign(docs(spark).where("doc_id is not null"), 16).collect()
    assert len(few) == docs(spark).where("doc_id is not null").count()
    table = clashing(spark, [(1000 + i, f"text number {i % 70}", "en", "s", 1) for i in range(300)])
    sharding.write(table, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {f.name for f in (tmp_path / "out").iterdir() if f.is_dir()} == {f"shard={i}" for i in range(4)}
    kept = Counter((r.doc_id, r.text, r["a.b"], r.docs_shard) for r in back.collect())
    assert kept == Counter((r.doc_id, r.text, r["a.b"], r["shard"]) for r in table.collect())
    assert all(r.n == 1 for r in back.groupBy("text").agg(F.countDistinct("shard").alias("n")).collect())


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def bag(text):
    w = words_of(text)
    return [zlib.crc32(x) % 10_000 for x in [*w, *(a + b" " + b for a, b in itertools.pairwise(w))]]


def plain_resample(rows, target):
    s, t = Counter(k for _, x in rows for k in bag(x)), Counter(k for x in target for k in bag(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (n_s + 10_000) / ((s[k] + 1) * (n_t + 10_000)))) for k in range(10_000)]
    made = []
    for i, text in rows:
        ks = bag(text)
        weight = sum(gain[k] for k in ks) // len(ks) if ks else 0
        noise = math.floor(-1000 * math.log(-math.log((int(hexdigits(f"7:{'' if i is None else i}")[:8], 16) + 0.5) / 2**32)))
        made.append([i, len(ks), weight, weight + noise, None, len(words_of(text))])
    able = sorted((r for r in made if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: len(able) * 25 // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in made)


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "ÀB", "x9"]
    rows = [(1000 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(60))), "en", "s", 1) for i in range(400)]
    rows += rows[:7] + [(None, " ".join(vocabulary), "en", "s", 1), (9000, "Wörd " * 9000, "en", "s", 1)]
    table, items = clashing(spark, rows), ["w1 w2 w3 w4", "w1 w2 x9", None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = resampling.resample(table, target).collect()
    untouched(got)
    want = plain_resample([(r.doc_id, r.text) for r in table.collect()], items)
    assert Counter((r.doc_id, r.dsir_features, r.dsir_weight, r.dsir_score, r.dsir_rank) for r in got) == want
    assert resampling.resample(docs(spark).limit(0), target).count() == 0
    none = resampling.resample(docs(spark, rows), target.limit(0), keep=["doc_id"])
    assert none.columns == ["doc_id", "dsir_features", "dsir_weight", "dsir_score", "dsir_rank"]
    assert Counter(map(tuple, none.collect())) == plain_resample([(r.doc_id, r.text) for r in docs(spark, rows).collect()], [])


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 5, 1000])
def test_long_texts_in_lists_have_the_same_features(longest, size):
    for text in ("one two three  four, five six", "", " ", "a", "ab cd"):
        w = words_of(text)
        want = Counter(zlib.crc32(b" ".join(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
        parts = list(resampling.features(text.encode(), longest, size))
        assert sum(n for n, _ in parts) == len(w) and Counter(k for _, ks in parts for k in ks) == want


def test_gains_stay_whole_where_counts_are_large():
    a, b = np.array([10**15, 0, 5]), np.array([0, 10**15, 5])
    assert resampling.bucket_gains(a, b).tolist() == [-34539, 34538, 0]
