"""Suggestions that follow arriving scores, against deriving everything again; the segmented store they are in."""

import random

import pytest
from pyspark.sql import functions as F

from shutterloom.operators import islands
from shutterloom.sources.segments import Segments
from shutterloom.streaming import derivation

KIND = """ord long, id long, src_folder string, drive_mode int, focal_mm double, captured_ms long, sub_sec_ms int, mtime_ms long, phash string, embedding array<double>, has_input boolean, scored boolean,
decode_ok boolean, af double, af_valid boolean, af_texture double, global_sharpness double, global_texture double, tenengrad double, blown_pct double, crushed_pct double, exposure_score double,
motion_blur_likelihood double, aesthetic double, eyes_open double, face_sharpness double, clip_sum double, faces array<struct<bbox:array<double>,eyes_open:double,face_sharpness:double>>"""
SCORE = ("has_input", "scored", "decode_ok", "af", "tenengrad", "exposure_score", "aesthetic", "drive_mode", "embedding")
RULES = derivation.Rules(level="low", span=16)


def start(n, rng):
    """Frames without scores: stretches of bursts, of look-alikes and of neither, in three folders."""
    t = 0
    for i in range(n):
        t += rng.choice([100, 100, 100, 400_000])
        yield (i, 1000 + i, f"f{i * 3 // n}", 8, 50.0, t, 0, t, rng.choice(["0" * 16, "f" * 16]), None, rng.random() < 0.9, False, False, None, True, 0.5, 0.5, 0.05, None, 0.0, 0.0, None, 0.1, None, None, None, 0.0, None)


def scores(rng, frames):
    for i in frames:
        ok = rng.random() < 0.9
        yield (i, True, ok, ok, rng.choice([0.02, 0.06, 0.6, 0.9]), 0.5, 0.9, rng.random(), rng.choice([0, 8, 8]), rng.choice([None, [1.0, 0.0], [0.0, 1.0]]), rng.randrange(100))


@pytest.fixture(autouse=True)
def few_small_jobs(spark):
    small = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def shown(rows):
    return {r.ord: tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in derivation.DERIVED) for r in rows}


def moved(row, by):
    """A derived row of a frame whose ord is larger."""
    named = {derivation.DERIVED.index(c) for c in ("cut_first", "cut_last", "burst_group", "sim_group")}
    return tuple(v + by if i in named and v is not None else v for i, v in enumerate(row))


def test_after_each_of_twenty_batches_as_if_derived_anew(spark, tmp_path):
    rng, n, batches, merge = random.Random(5), 120, 20, 4
    first = list(start(n, rng))
    store = derivation.opened(spark, str(tmp_path / "store"), spark.createDataFrame(first, KIND), RULES, span=10, merge=merge)
    names = [f.split()[0] for f in KIND.replace("array<struct<bbox:array<double>,eyes_open:double,face_sharpness:double>>", "x").replace("\n", " ").split(", ")]
    kind = "ord long, has_input boolean, scored boolean, decode_ok boolean, af double, tenengrad double, exposure_score double, aesthetic double, drive_mode int, embedding array<double>, seq long"
    frames, every, found, read, lost, held = {r[0]: list(r) for r in first}, [], {}, [], 0, set()
    for b in range(1, batches + 1):
        at = rng.choice([20, 21, 60, rng.randrange(n)])
        got = list(scores(rng, [min(n + 1, at + k) for k in range(rng.choice([1, 1, 5]))]))  # one frame there is not
        said = derivation.rederive(store, spark.createDataFrame(got, kind), b, RULES)
        for row in sorted(got, key=lambda r: r[-1]):
            for name, value in zip(SCORE, row[1:-1], strict=True):
                if row[0] in frames:
                    frames[row[0]][names.index(name)] = value
        rows = store.read().collect()
        found |= {i + 1000 * b: moved(r, 1000 * b) for i, r in shown(rows).items()}
        every += [(i + 1000 * b, *r[1:]) for i, r in frames.items()]
        now = {r.ord for r in rows if r.verdict}
        read, lost, held = [*read, said["read"]], lost + bool(held - now), now
        assert said["derived"] <= said["read"] and len(rows) == n
    # the states after all batches, one behind the other with gaps in between, derived as a whole
    whole = shown(derivation.derive(spark.createDataFrame(every, KIND), RULES).collect())
    assert whole == found
    assert lost and sum(read) < 0.6 * n * batches  # some frame lost its suggestion, and much of the store stayed unread
    assert derivation.rederive(store, spark.createDataFrame(got, kind), batches, RULES) == {"read": 0, "derived": 0}  # again
    assert derivation.rederive(store, spark.createDataFrame([], kind), batches + 1, RULES) == {"read": 0, "derived": 0}
    assert max(len(p) for p in store.manifest()["buckets"].values()) <= merge
    best = {r.ord for r in derivation.suggestions(store).where("verdict = 'favorite'").collect()}
    assert best <= held and len(best) <= 15


def test_a_folder_that_loses_its_only_suggestion(spark, tmp_path):
    rng = random.Random(1)
    store = derivation.opened(spark, str(tmp_path / "store"), spark.createDataFrame([(*r[:9], None, False, *r[11:]) for r in start(6, rng)], KIND), RULES, span=10)
    assert derivation.suggestions(store).count() == 0
    kind = "ord long, scored boolean, decode_ok boolean, af double, tenengrad double, exposure_score double"
    stream_in = str(tmp_path / "in")
    for af, want in ((0.02, ["reject"]), (0.5, []), (0.9, ["keep"])):
        spark.createDataFrame([(3, True, True, af, af, 0.9)], kind).coalesce(1).write.mode("append").parquet(stream_in)
        stream = spark.readStream.schema(kind).parquet(stream_in)
        derivation.rederived(stream, store, str(tmp_path / "checkpoint"), RULES).trigger(availableNow=True).start().awaitTermination()
        assert [r.verdict for r in derivation.suggestions(store).collect()] == want


def test_gaps_in_the_order_part_runs(spark):
    rows = [(*r[:5], 100 * r[0], 0, 100 * r[0], *r[8:10], True, *r[11:]) for r in start(9, random.Random(2))]
    df = spark.createDataFrame([("x", *r[1:]) if r[0] == 99 else (r[0] + (r[0] > 3), r[1], "a", *r[3:]) for r in rows], KIND)
    got = [(r.ord, r.burst_group, r.burst_pos) for r in islands.bursts(df, span=4).orderBy("ord").collect()]
    assert got == [(i, 0, i + 1) for i in range(4)] + [(i, 1, i - 4) for i in range(5, 10)]


def test_segments_replace_rows_and_survive_a_failed_write(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "s"), "k", span=10, merge=2)
    assert store.read() is None and store.manifest()["number"] == -1
    rows = lambda *xs: spark.createDataFrame(list(xs), "k long, v string")
    store.write(rows((1, "a"), (2, "b"), (25, "c")), 0)
    store.write(rows((2, "B"), (11, "d")), 1)
    store.write(rows((2, "again")), 1)  # done already
    assert {(r.k, r.v) for r in store.read().collect()} == {(1, "a"), (2, "B"), (11, "d"), (25, "c")}
    assert {r.k for r in store.read([1]).collect()} == {11} and store.read([7]).count() == 0 and store.buckets_of(rows((25, ""), (None, ""))) == [2]
    broken = rows((3, "x")).withColumn("v", F.raise_error(F.lit("disk")).cast("string"))
    with pytest.raises(Exception, match="disk"):
        store.write(broken, 2)
    assert store.manifest()["number"] == 1 and store.read().count() == 4
    for n in range(2, 6):
        store.write(rows((2, f"v{n}")), n)
    assert store.raw([0]).count() <= 4 and {r.v for r in store.read([0]).collect()} == {"a", "v5"}
