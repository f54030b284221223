"""Semantics that SQL on the tables does not reach."""

import pytest
from pyspark.sql import functions as F

from shutterloom.functions import expr, formats
from shutterloom.operators import islands, ratings, verdict, winner
from shutterloom.operators.ordering import capture_order, numbered

FRAME = "id int, ord int, src_folder string, drive_mode int, focal_mm double, captured_ms bigint, sub_sec_ms int, mtime_ms bigint, phash string, embedding array<double>, has_input boolean"


def frame(i, **change):
    row = {"id": i, "ord": i, "src_folder": "a", "drive_mode": 8, "focal_mm": 85.0, "captured_ms": 100 * i, "sub_sec_ms": 0, "mtime_ms": 100 * i + 1, "phash": None, "embedding": None, "has_input": True}
    return tuple((row | change).values())


def groups(df, prefix):
    return [r[0] for r in df.orderBy("ord").select(f"{prefix}_group").collect()]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([frame(0), frame(1), frame(2)], [0, 0, 0]),
        ([frame(0), frame(1, captured_ms=699)], [0, 0]),
        ([frame(0), frame(1, captured_ms=700)], [None, None]),  # strictly less
        ([frame(0), frame(1, src_folder="b"), frame(2)], [None, None, None]),  # another folder between
        ([frame(0), frame(1, has_input=False), frame(2)], [None, None, None]),  # a wall
        ([frame(0), frame(1, drive_mode=0)], [None, None]),
        ([frame(0), frame(1, drive_mode=None)], [None, None]),
        ([frame(0), frame(1, focal_mm=85.02)], [None, None]),
        ([frame(0), frame(1, sub_sec_ms=None, captured_ms=1900, mtime_ms=5)], [0, 0]),  # coarse clocks: the file time decides
        ([frame(0), frame(1, sub_sec_ms=None, captured_ms=2001, mtime_ms=5)], [None, None]),
        ([frame(0), frame(1), frame(2, captured_ms=9000), frame(3, captured_ms=9100)], [0, 0, 1, 1]),
    ],
)
def test_bursts(spark, rows, want):
    assert groups(islands.bursts(spark.createDataFrame(rows, FRAME)), "burst") == want


def test_similar_sets_take_hash_or_embedding_and_walls(spark):
    rows = [frame(i, drive_mode=0, phash=h, embedding=e, captured_ms=t) for i, (h, e, t) in enumerate([("0" * 16, None, 0), ("0" * 13 + "3ff", None, 1), ("f" * 16, [1.0, 0.0], 2), (None, [0.95, 0.1], 3), (None, [0.95, 0.1], 300_004)])]
    got = islands.similar_sets(islands.bursts(spark.createDataFrame(rows, FRAME)))
    assert groups(got, "sim") == [0, 0, 1, 1, None]


def test_a_zero_file_time_is_unknown_for_similar_sets_only(spark):
    rows = [frame(i, captured_ms=None, drive_mode=0, phash="0" * 16, mtime_ms=0) for i in range(2)]
    assert groups(islands.similar_sets(islands.bursts(spark.createDataFrame(rows, FRAME))), "sim") == [None, None]
    rows = [frame(i, captured_ms=None, mtime_ms=0) for i in range(2)]
    assert groups(islands.bursts(spark.createDataFrame(rows, FRAME)), "burst") == [0, 0]


WIN = "g int, ord int, id string, scored boolean, eligible boolean, eyes_open double, face_sharpness double, af double, global_sharpness double, clip_sum double"
A, B, C = ("A", None, None, 0.5), ("B", 0.9, 0.4, 0.4), ("C", 0.1, 0.6, 0.6)


@pytest.mark.parametrize(("order", "want"), [((A, B, C), "C"), ((A, C, B), "B"), ((B, A, C), "C"), ((B, C, A), "A"), ((C, A, B), "B"), ((C, B, A), "A")])
def test_the_winner_is_folded_in_order(spark, order, want):
    rows = [(0, i, n, True, True, e, f, af, 0.5, 0.1) for i, (n, e, f, af) in enumerate(order)]
    assert winner.winners(spark.createDataFrame(rows, WIN), "g").first().winner_id == want


def test_no_winner_of_a_half_scored_or_ineligible_group(spark):
    row = lambda g, i, scored, ok: (g, i, f"{g}{i}", scored, ok, None, None, 0.5, 0.5, 0.1)
    rows = [row(0, 0, True, True), row(0, 1, False, True), row(1, 0, True, False), row(1, 1, True, None), row(2, 0, True, False), row(2, 1, True, True)]
    assert {r.g: r.winner_id for r in winner.winners(spark.createDataFrame(rows, WIN), "g").collect()} == {0: None, 1: None, 2: "21"}


JUDGED = {"id": 0, "af": 0.7, "af_valid": True, "af_texture": 0.6, "global_sharpness": 0.55, "global_texture": 0.05, "tenengrad": 0.7, "blown_pct": 0.002, "crushed_pct": 0.002, "exposure_score": 0.9, "motion_blur_likelihood": 0.05, "decode_ok": True, "aesthetic": 0.5, "faces": None}
JUDGED |= {f"{p}_{c}": v for p in ("burst", "sim") for c, v in (("group", None), ("pos", None), ("len", None), ("is_winner", False), ("margin", 0.0))}
JUDGED_KIND = "id int, af double, af_valid boolean, af_texture double, global_sharpness double, global_texture double, tenengrad double, blown_pct double, crushed_pct double, exposure_score double, motion_blur_likelihood double, decode_ok boolean, aesthetic double, faces array<struct<bbox:array<double>,eyes_open:double,face_sharpness:double>>"
JUDGED_KIND += "".join(f", {p}_group int, {p}_pos int, {p}_len int, {p}_is_winner boolean, {p}_margin double" for p in ("burst", "sim"))
BLINK = [{"bbox": [0.0, 0.0, 0.5, 0.5], "eyes_open": 0.0, "face_sharpness": 0.5}, {"bbox": [0.0, 0.0, 0.1, 0.1], "eyes_open": 0.9, "face_sharpness": 0.5}]


@pytest.mark.parametrize(
    ("change", "want", "confidence", "reasons"),
    [
        ({}, "keep", 0.7, ["sharp, well exposed"]),
        ({"decode_ok": False}, None, 0.0, []),
        ({"af": 0.03, "tenengrad": 0.1}, "reject", 0.75, ["soft focus"]),
        ({"af": 0.03, "tenengrad": 0.1, "motion_blur_likelihood": 0.6}, "reject", 0.75, ["motion blur"]),
        ({"af": 0.03, "tenengrad": 0.1, "af_valid": False}, None, 0.375, ["soft focus"]),  # below the level: confidence stays
        ({"af": 0.03, "tenengrad": 0.1, "af_texture": 0.1}, None, 0.0, []),
        ({"global_texture": 0.2, "global_sharpness": 0.1, "tenengrad": 0.04}, "reject", 0.9, ["heavy blur"]),
        ({"burst_group": 1, "burst_pos": 2, "burst_len": 3, "burst_margin": 0.2}, "reject", 0.8, ["not best of burst (2 of 3)"]),
        ({"burst_group": 1, "burst_pos": 1, "burst_len": 3, "burst_is_winner": True}, "keep", 0.7, ["best of burst", "sharp, well exposed"]),
        ({"sim_group": 1, "sim_pos": 1, "sim_len": 2, "sim_margin": 0.05}, None, 0.0, []),  # a loser, but by too little; and no keep
        ({"faces": BLINK, "blown_pct": 0.25}, "reject", 1.0, ["closed eyes", "blown highlights"]),
    ],
)
def test_verdicts(spark, change, want, confidence, reasons):
    got = verdict.with_verdict(spark.createDataFrame([tuple((JUDGED | change).values())], JUDGED_KIND)).first()
    assert (got.verdict, round(got.confidence, 6), got.reasons) == (want, confidence, reasons)


def test_sizes_are_rounded_as_their_doubles_are(spark):
    sizes = {786_432 * 4099: "3074.2 MB", 262_144: "0.2 MB", 786_432: "0.8 MB", 1_258_291: "1.2 MB"}  # exactly .25, .25 and .75; and 1.1999
    rows = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", formats.file_size(F.col("n")).alias("size"), formats.shutter(F.lit(1.25)).alias("s"), formats.exposure_bias(F.lit(-0.35)).alias("ev"))
    assert {r.n: (r.size, r.s, r.ev) for r in rows.collect()} == {k: (v, "1.2s", "-0.3 EV") for k, v in sizes.items()}


def test_a_clipped_frame_just_at_the_high_level_is_rejected(spark):
    # the bonuses are added one by one: 0.7 + 0.05 + 0.05 is 0.8, 0.7 + 0.1 is less
    change = {"burst_group": 1, "burst_pos": 2, "burst_len": 3, "burst_margin": 0.7 * verdict.BURST_SCALE, "blown_pct": 0.25, "crushed_pct": 0.35}
    got = verdict.with_verdict(spark.createDataFrame([tuple((JUDGED | change).values())], JUDGED_KIND), "high").first()
    assert (got.verdict, got.confidence) == ("reject", 0.8)


def test_a_clipped_frame_just_at_the_medium_level_is_rejected(spark):
    # the bonuses are added one by one: 0.5499999999999999 + 0.05 + 0.05 is 0.65, 0.5499999999999999 + 0.1 is less
    change = {"burst_group": 1, "burst_pos": 2, "burst_len": 3, "burst_margin": 0.5499999999999999 * verdict.BURST_SCALE, "blown_pct": 0.25, "crushed_pct": 0.35}
    got = verdict.with_verdict(spark.createDataFrame([tuple((JUDGED | change).values())], JUDGED_KIND), "medium").first()
    assert (got.verdict, got.confidence) == ("reject", 0.65)


def test_favourites_are_capped_with_ties_by_id(spark):
    rows = [tuple((JUDGED | {"id": i, "aesthetic": 0.9 if i % 2 else 0.6}).values()) for i in range(100)]
    got = verdict.with_favourites(verdict.with_verdict(spark.createDataFrame(rows, JUDGED_KIND)))
    assert [r.id for r in got.where("verdict = 'favorite'").orderBy("id").collect()] == [1, 3, 5, 7, 9]


def test_numbering_has_nulls_last(spark):
    df = numbered(spark.createDataFrame([(5,), (None,), (1,), (12,)], "x int"), F.floor(F.col("x") / 10), F.col("x").asc_nulls_last())
    assert {r.x: r.ord for r in df.collect()} == {1: 0, 5: 1, 12: 2, None: 3}


def test_ordering_has_nulls_last_and_ties_together(spark):
    rows = [(i * 37 % 101, f"p{i}") for i in range(300)] + [(None, "z"), (None, "a"), (5, "same"), (5, "same")]
    df = capture_order(spark.createDataFrame(rows, "mtime_ms int, path string").repartition(7))
    got = [(r.ord, r.mtime_ms, r.path) for r in df.orderBy("ord").collect()]
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [x[0] for x in got] == list(range(304)) and [x[1:] for x in got] == want
    assert capture_order(spark.createDataFrame([], "mtime_ms int, path string")).count() == 0


def test_expressions(spark):
    cases = [
        (expr.hamming(F.lit("ffffffffffffffff"), F.lit("8000000000000000")), 63), (expr.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0))), 3.0),
        (expr.captured_ms(F.lit("2024-01-02T03:04:05"), F.lit(60)), 1704164645060), (expr.captured_ms(F.lit("2024-01-02"), F.lit(0)), None),
        (expr.sub_sec_ms(F.lit("5 ")), 500), (expr.sub_sec_ms(F.lit("12345")), 123), (expr.sub_sec_ms(F.lit("1a")), None),
        (expr.normalised_datetime(F.lit("2024:01:02 03:04:05")), "2024-01-02T03:04:05"), (expr.gps_degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s")), -10.5),
        (expr.exact_double(F.lit(0.12).cast("float")), 0.12), (expr.backoff_ms(F.lit(4)), None), (expr.mid_dims(F.lit(6960), F.lit(4640))["height"], 1707),
        (formats.shutter(F.lit(0.004)), "1/250s"), (formats.shutter(F.lit(1.5)), "1.5s"), (formats.shutter(F.lit(0.0)), None), (formats.exposure_bias(F.lit(-0.33)), "-0.3 EV"),
        (formats.sanitised_folder(F.lit(' <a:b>. ')), "ab"), (formats.rejected_folder(F.lit("CON.txt")), "_rejected"), (formats.basename(F.lit("C:\\x\\y.CR3")), "y.CR3"),
        (formats.strip_ext(F.lit("a.b/c.CR3")), "a.b/c"), (formats.join_path(F.lit("C:\\x\\"), F.lit("y")), "C:\\x\\y"), (formats.folder_set(F.array(F.lit("x/aaa"), F.lit("bbb"), F.lit("ccc")), 15), "aaa +2 more"), (formats.folder_set(F.array(F.lit("x/aaa"), F.lit("bbb"))), "aaa + bbb"), (formats.folder_set(F.array(F.lit("abcdefghij"), F.lit("bbb")), 12), "ab…j +1 more"),
        (formats.relative_time(F.lit(0), F.lit(90_000)), "1 minute ago"), (formats.relative_time(F.lit(0), F.lit(59_500)), "1 minute ago"), (formats.aperture(F.lit(2.8)), "ƒ/2.8"), (formats.aperture(F.lit(4.0)), "ƒ/4"), (formats.tail_path(F.lit("a/bcd/"), 4), "…cd/"), (formats.basename(F.lit("a/")), "a/"), (formats.suggestion_title(F.lit("keep"), F.lit(0.705), F.array(F.lit("x"))), "suggested keep · 71% · x"),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_frames_without_a_group_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("id"), F.when(F.col("id") < 4, F.floor(F.col("id") / 2)).alias("sim_group"), F.lit(True).alias("scored"), F.lit(True).alias("eligible"),
        F.lit(None).cast("double").alias("eyes_open"), F.lit(None).cast("double").alias("face_sharpness"), (F.col("id") / 4000).alias("af"), F.lit(0.5).alias("global_sharpness"), F.lit(0.1).alias("clip_sum"),
    )
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = winner.with_winner(rows, "sim").withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.id for r in got if r.sim_is_winner} == {"1", "3"} and len(got) == 4000
    tasks = [r._task for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 1500  # of 4 tasks
