"""Files, containers, pixels, sidecars, the store and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import pixels, sidecar
from shutterloom.operators import inputs, islands, storage
from shutterloom.operators.ordering import settled, staged
from shutterloom.sources import container, files, settings, store
from shutterloom.streaming import scoring


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def tiff(entries):
    """A little-endian directory of (tag, type, values)."""
    head, body = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    free = 10 + 12 * len(entries) + 4
    for tag, kind, raw, count in entries:
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(body))
        head += struct.pack("<HHI", tag, kind, count) + place
        body += raw if len(raw) > 4 else b""
    return head + b"\0\0\0\0" + body


def photo():
    jpeg = b"\xff\xd8\xff\xe0preview"
    exif = tiff([(0x829A, 5, struct.pack("<II", 1, 250), 1), (0x8827, 3, struct.pack("<H", 400), 1), (0x9003, 2, b"2024:01:02 03:04:05\0", 20)])
    gps = tiff([(1, 2, b"S\0", 2), (2, 5, struct.pack("<6I", 10, 1, 30, 1, 0, 1), 3)])
    shot = struct.pack("<6H", 12, 0, 0, 0, 0, 4)
    areas = (0, 0, 3, 0, 0, 0, 6000, 4000, *[1] * 6, 600, -600 & 0xFFFF, 0, 1000, 500, 0)
    maker = tiff([(0x0001, 3, shot, 6), (0x0026, 3, struct.pack(f"<{len(areas)}H", *areas), len(areas))])
    meta = box(b"uuid", bytes(16) + box(b"CMT1", tiff([(0x0112, 3, struct.pack("<H", 6), 1), (0x0110, 2, b"Cam X\0", 6)])) + box(b"CMT2", exif) + box(b"CMT3", maker) + box(b"CMT4", gps) + box(b"THMB", b"hd\xff\xd8\xff\xdbthumb"))
    table = lambda off, size: box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, size, 1)) + box(b"co64", struct.pack(">IIQ", 0, 1, off))))))
    return box(b"ftyp", b"crx ") + box(b"moov", meta + table(9000, 5) + table(700, 33)) + box(b"uuid", container.PREVIEW_UUID + box(b"PRVW", b"hd" + jpeg)), jpeg


def test_container(spark):
    data, jpeg = photo()
    assert container.preview(data) == jpeg
    got = container.parsed(spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None), ("d", data[:40])], "path string, content binary")).orderBy("path").collect()
    one = got[0]
    assert (one.camera, one.orientation, one.iso, one.shutter_seconds, one.captured_at, one.gps_lat) == ("Cam X", 6, 400, 0.004, "2024:01:02 03:04:05", -10.5)
    assert (one.full_offset, one.full_bytes, one.preview_bytes) == (700, 33, len(jpeg))
    assert [r.decode_ok for r in got] == [True, False, False, False]
    # two areas, at (600, 500) and (-600, 1000) from the middle: half way across, 31.25 % down, then turned
    assert (one.drive_mode, one.af_x_pct, one.af_y_pct) == (4, 100 - 31.25, 50.0)
    known = inputs.image_metadata(container.parsed(spark.createDataFrame([("a", data)], "path string, content binary"))).first()
    assert (known.captured_at, known.drive_mode, known.file_size, known.phash) == ("2024-01-02T03:04:05", 4, None, None)


def test_focus_point_of_broken_records():
    record = lambda *v: container.focus_point(container.Tiff(tiff([(0x0026, 3, struct.pack(f"<{len(v)}H", *v), len(v))])), 1)
    assert record(0, 0, 1, 0, 0, 0, 100, 100, 1, 1, 0, 0) is None  # no area in use
    assert record(0, 0, 2, 0, 0, 0, 100, 100, 1, 1, 5, 5) is None  # cut short
    assert record(0, 0, 0, 0, 0, 0, 100, 100) is None and record(1) is None
    assert container.focus_point(container.Tiff(b""), 1) is None and container.drive_mode(container.Tiff(tiff([(1, 3, b"ab", 1)]))) is None


def test_orientation_is_spliced_in():
    jpeg = b"\xff\xd8\xff\xe1\x00\x0aExif\0\0xx\xff\xe0\x00\x04ab\xff\xda\x00\x02body\xff\xd9"
    made = container.oriented(jpeg, 6)
    assert made[:2] == b"\xff\xd8" and len(made) == len(jpeg) - 12 + 36 and made.count(b"Exif\0\0") == 1 and made.endswith(jpeg[14:])
    assert container.Tiff(made[12:]).number(0x0112) == 6
    assert container.oriented(jpeg, 1) == jpeg and container.oriented(jpeg, 5) == jpeg and container.oriented(b"junk", 6) == b"junk"


def test_bounded_reads(spark, tmp_path, monkeypatch):
    data, jpeg = photo()
    full = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02" + b"z" * 18 + b"\xff\xd9"
    whole = (data + box(b"free", bytes(700 - len(data) - 8)) if len(data) < 692 else data) + struct.pack(">I", 90_000_000) + b"mdat" + full + bytes(5000)
    place = whole.index(full)
    whole = whole.replace(struct.pack(">Q", 700), struct.pack(">Q", place)).replace(struct.pack(">III", 0, 33, 1), struct.pack(">III", 0, len(full), 1))
    (tmp_path / "1.CR3").write_bytes(whole)
    (tmp_path / "2.CR3").write_bytes(whole.replace(container.PREVIEW_UUID, bytes(16)).replace(b"THMB", b"NONE").replace(struct.pack(">Q", place), struct.pack(">Q", place + 1)))
    (tmp_path / "3.CR3").write_bytes(b"junk" * 10)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("1.CR3", "2.CR3", "3.CR3", "gone.CR3")] + [((tmp_path / "1.CR3").as_uri(),)], "path string")
    monkeypatch.setattr(container, "HEAD", 64)  # grows as far as it must
    got = {r.path.rsplit("/", 1)[1] + r.path[:4]: r for r in container.previews(paths).collect()}
    key = lambda n: n + str(tmp_path)[:4]
    assert bytes(got[key("1.CR3")].jpeg) == container.oriented(jpeg, 6) and got["1.CR3file"].decode_ok and got[key("1.CR3")].file_size == len(whole)
    assert [got[key(n)].error for n in ("1.CR3", "2.CR3", "3.CR3")] == [None, "no preview", "no preview"] and "gone" in got[key("gone.CR3")].error
    small = {r.path.rsplit("/", 1)[1]: r for r in container.thumbnails(paths).collect()}
    assert bytes(small["1.CR3"].jpeg)[-5:] == b"thumb" and small["2.CR3"].error == "no thumbnail"
    large = {r.path.rsplit("/", 1)[1]: r for r in container.full_images(paths).collect()}
    # by the range that is named, or where that is wrong, by a look at the payload
    assert bytes(large["1.CR3"].jpeg) == bytes(large["2.CR3"].jpeg) == container.oriented(full, 6) and not large["3.CR3"].decode_ok


def test_scores_of_the_focus_area(spark):
    rgb = np.full((200, 300, 3), 118, dtype=np.uint8)
    rgb[:60, :60] = board(60, 60)  # sharp only in a corner
    kind = "path string, width int, height int, rgb binary, orientation int, af_x_pct double, af_y_pct double, shutter_seconds double, focal_mm double"
    rows = [("corner", 1, 8.0, 8.0), ("turned", 6, 92.0, 8.0), ("half", 3, 92.0, 92.0), ("none", 1, None, None)]
    got = {r.path: r for r in pixels.features(spark.createDataFrame([(p, 300, 200, rgb.tobytes(), o, x, y, 0.1, 50.0) for p, o, x, y in rows], kind)).collect()}
    assert got["corner"].af == got["turned"].af == got["half"].af > 0.5 and got["none"].af == 0.0
    assert [got[n].af_valid for n in ("corner", "none")] == [True, False] and got["corner"].af_texture > 0.5 > got["none"].af_texture
    assert got["corner"].tenengrad > 0.5 and abs(got["none"].motion_blur_likelihood - (1 - got["none"].global_sharpness)) < 1e-9
    assert pixels.eye_box(50.0, 50.0, 100.0, 300, 200) == (23, 34, 55, 33) and pixels.eye_box(0.0, 0.0, 100.0, 300, 200)[:2] == (0, 0) and pixels.eye_box(5.0, 5.0, 10.0, 300, 200) is None
    assert pixels.planes(rgb).shape == (3, 200, 300) and pixels.padded_planes(rgb[:, :, :]).shape == (3, 224, 320) and pixels.padded_planes(rgb)[0, 0, 0] == rgb[0, 0, 2]
    assert pixels.cropped(rgb, (1, 2, 3, 4)).shape == (4, 3, 3)


def test_files_are_moved_with_their_sidecars(spark, tmp_path):
    for name in ("in/1.cr3", "in/1.xmp", "in/2.cr3", "in/3.cr3", "in/3.xmp", "out/2.cr3", "out/3.xmp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    at = lambda n: str(tmp_path / n)
    wanted = spark.createDataFrame([(at(f"in/{i}.cr3"),) for i in (1, 2, 3, 4)], "path string")
    there = spark.createDataFrame([(at(n),) for n in ("in/1.cr3", "in/3.cr3", "in/2.cr3", "in/4.cr3")], "path string")
    plan = storage.transfer_plan(wanted, there, str(tmp_path / "out"))  # does not know of out/2.cr3, and 4 has gone
    done = storage.transferred(plan, move=True).collect()
    assert {r.source[-5:]: (r.action, r.error) for r in done} == {"1.cr3": ("do", None), "2.cr3": ("skip_exists", None), "3.cr3": ("do", None), "4.cr3": ("skip_missing", None)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.cr3", "1.xmp", "2.cr3", "3.cr3", "3.xmp"] and (tmp_path / "out/3.xmp").read_text() == "out/3.xmp"
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["2.cr3", "3.xmp"]
    assert {r.action for r in storage.transferred(plan, move=True).collect()} == {"skip_exists", "skip_missing"}
    assert {r.error for r in storage.transferred(plan.where("source like '%2.cr3'").withColumn("dest", F.lit(str(tmp_path / "in/2.cr3/x.cr3"))), move=False).collect()} != {None}


def test_stored_recents(spark):
    v2 = '[{"paths": ["b", "a", "b"], "count": 3, "rated": 9, "lastOpened": "x", "done": true}, {"paths": [], "lastOpened": "x"}, {"paths": ["c", 1], "lastOpened": "x"}, 7, {"paths": ["d"], "count": "many", "lastOpened": "y"}]'
    v1 = '[{"path": "e", "count": 2, "rated": 1, "lastOpened": "z", "done": true}, {"path": 3, "lastOpened": "z"}]'
    rows = [(1, v2, v1), (2, None, v1), (3, "broken", v1), (4, None, None), (5, "[" + ",".join('{"paths": ["%d"], "lastOpened": "x"}' % i for i in range(9)) + "]", None)]
    got = settings.recents(spark.createDataFrame(rows, "k int, v2 string, v1 string")).collect()
    found = sorted((r.k, r.paths, r["count"], r.rated, r.last_opened, r.done) for r in got)
    assert found[:3] == [(1, ["b", "a"], 3, 3, "x", True), (1, ["d"], 0, 0, "y", False), (2, ["e"], 2, 1, "z", False)]
    assert {r[0] for r in found} == {1, 2, 5} and [r[1] for r in found if r[0] == 5] == [[str(i)] for i in range(5)]


def test_runs_across_ranges(spark):
    kind = "id int, ord bigint, src_folder string, drive_mode int, focal_mm double, captured_ms bigint, sub_sec_ms int, mtime_ms bigint, has_input boolean"
    rows = [(i, i, "a", 8, 85.0, 100 * i + 5000 * (i // 23), 0, 0, i != 40) for i in range(60)]
    df = settled(spark.createDataFrame(rows, kind))
    got = [[(r.burst_group, r.burst_pos, r.burst_len) for r in islands.bursts(df, span=s).orderBy("ord").collect()] for s in (3, 7, 1000)]
    assert got[0] == got[1] == got[2]
    assert got[0][0] == (0, 1, 23) and got[0][22] == (0, 23, 23) and got[0][23] == (1, 1, 17) and got[0][40] == (None, None, None) and got[0][41] == (2, 1, 5) and got[0][59] == (3, 14, 14)


def test_jpeg_end():
    body = b"\xff\xd8\xff\xe1\x00\x06\xff\xd9xx\xff\xda\x00\x02ab\xff\x00c\xff\xd0d\xff\xd9tail"
    assert container.jpeg_end(body, 0) == len(body) - 4
    assert container.jpeg_end(body[:-6], 0) is None


def board(h=256, w=256):
    y, x = np.mgrid[:h, :w]
    return np.where(((x // 2 + y // 2) % 2 == 0)[..., None], 30, 220).astype(np.uint8).repeat(3, axis=2)


def test_pixels(spark):
    flat = np.full((256, 256, 3), 118, dtype=np.uint8)
    assert pixels.laplacian_variance(pixels.luma(flat)) == 0 and pixels.phash(np.zeros((0, 5), dtype=np.uint8)) == "0" * 16
    assert pixels.laplacian_variance(pixels.luma(board())) > 1000 and abs(pixels.exposure_score(pixels.luma(flat)) - 1) < 0.02
    white = np.full((4, 4, 3), 255, dtype=np.uint8)
    assert pixels.clipped(white) == (1.0, 0.0) and pixels.clipped(0 * white) == (0.0, 1.0)
    rng = np.random.default_rng(0)
    scene = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    twice = scene.repeat(2, axis=0).repeat(2, axis=1)
    assert bits(pixels.phash(scene), pixels.phash(twice)) <= 2 < 16 < bits(pixels.phash(scene), pixels.phash(scene[:, ::-1]))
    rows = [("ok", 256, 256, board().tobytes()), ("short", 256, 256, b"x"), ("none", None, 1, None)]
    got = {r.path: r for r in pixels.features(spark.createDataFrame(rows, "path string, width int, height int, rgb binary")).collect()}
    assert got["ok"].decode_ok and not got["short"].decode_ok and not got["none"].decode_ok and got["short"].phash is None
    assert pixels.suppressed(np.array([[0, 0, 10, 10, 0.9], [1, 1, 10, 10, 0.8], [50, 50, 5, 5, 0.7]])).tolist() == [0, 2]
    assert pixels.clip_mask(white)[..., 3].any() and pixels.peaking_mask(board())[..., 3].any() and (pixels.bilinear(flat, 7, 5) == 118).all()
    assert pixels.decoded_heads(np.array([0.9, 0.1]), np.array([0.9, 0.9]), np.zeros((2, 4)), np.zeros((2, 10)), 8, 2).shape == (1, 15)


SIDECAR = '<x:xmpmeta><rdf:RDF><rdf:Description rdf:about="" {}></rdf:Description></rdf:RDF></x:xmpmeta>'


@pytest.mark.parametrize(
    ("attributes", "rating", "star"),
    [
        ('xmpDM:pick="1"', "keep", None), ('xmpDM:pick="-1"', "reject", None), ('xmpDM:pick="0" xmp:Rating="5"', None, 5), ('xmpDM:pick="1" xmp:Rating="1"', "favorite", 1),
        ('xmpDM:pick="1" loom:fav="flag" xmp:Rating="4"', "favorite", 4), ('xmpDM:pick="1" loom:fav="star" xmp:Rating="1"', "favorite", None),
        ('xmp:CreatorTool="Shutterloom" xmp:Rating="-1"', "reject", None), ('xmp:CreatorTool="Shutterloom" xmp:Rating="5"', "favorite", 5), ('xmp:Rating="5"', None, 5), ('xmp:Rating="1.0"', None, None),
    ],
)
def test_reading_sidecars(spark, attributes, rating, star):
    x = F.lit(SIDECAR.format(attributes))
    assert tuple(spark.range(1).select(sidecar.rating(x), sidecar.user_star(x)).first()) == (rating, star)


def test_writing_sidecars_is_idempotent_and_keeps_the_users_stars(spark):
    user = SIDECAR.format('xmp:Rating="3" dc:title="t"')
    favourite = sidecar.rated(user, "favorite")
    assert 'loom:fav="flag"' in favourite and 'xmp:Rating="3"' in favourite and sidecar.rated(favourite, "favorite") == favourite
    assert 'xmp:Rating="3"' in sidecar.cleared(sidecar.rated(favourite, "reject"))
    ours = sidecar.rated(None, "favorite")
    assert 'xmp:Rating="1"' in ours and "xmp:Rating" not in sidecar.rated(ours, "keep") and sidecar.cleared(ours) is None
    for mark in sidecar.USER_MARKS:  # what others wrote is never deleted
        assert sidecar.cleared(sidecar.rated(SIDECAR.format(f'xmp:CreatorTool="Shutterloom" {mark}x="1"'), "keep")) is not None
    for value in ("keep", "reject", "favorite"):
        x = F.lit(sidecar.rated(None, value))
        assert spark.range(1).select(sidecar.rating(x).alias("x")).first().x == value


def test_scans_and_sidecar_joins(spark, tmp_path):
    for name in ("a/1.CR3", "a/2.cr3", "a/note.txt", "a/.hidden", "a/_Rejected/3.cr3", "a/1.xmp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(SIDECAR.format('xmpDM:pick="1"'))
    root = str(tmp_path)
    found = files.scanned(spark, root, "_rejected")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["1.CR3", "2.cr3"]
    assert files.ignored_count(spark, root, "_rejected").first().ignored == 1
    rated = files.with_sidecar(found, files.sidecars(spark, root)).select("path", sidecar.rating(F.col("content")).alias("r"))
    assert sorted((r.path.rsplit("/", 1)[1], r.r) for r in rated.collect()) == [("1.CR3", "keep"), ("2.cr3", None)]


def test_store(spark, tmp_path):
    kind = "path string, mtime_ms bigint, bytes bigint"
    found = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], kind)
    kept = spark.createDataFrame([("a", 1, 10, 1), ("b", 1, 20, 1), ("c", 3, 30, 0)], kind + ", version int")
    assert [r.path for r in store.hits(found, kept).collect()] == ["a"]
    assert sorted(r.path for r in store.misses(found, kept).collect()) == ["b", "c"]
    assert store.refreshed(found, kept, lambda f: f).count() == 3
    full = "path string, used bigint, bytes bigint, payload string"
    after = store.put_within(spark.createDataFrame([("new", 9, 50, "p"), ("large", 9, 50, "p" * 99)], full), spark.createDataFrame([("old", 1, 30, "p"), ("mid", 2, 30, "p")], full), 100, 10)
    assert sorted(r.path for r in after.collect()) == ["mid", "new"]
    (tmp_path / "f").write_text("x")
    assert [files.folder_state(str(tmp_path / n)) for n in ("", "f", "gone")] == ["ok", "not_a_directory", "not_found"]
    assert pixels.is_blank(np.zeros((2, 2, 4), dtype=np.uint8)) and not pixels.is_blank(np.full((2, 2, 4), 1, dtype=np.uint8))


def test_staging_compares_composed_paths(spark):
    images = spark.createDataFrame([(0, "a/b/\u00e9.cr3"), (4, "a/b/x.cr3")], "id bigint, path string")
    got = staged(images, spark.createDataFrame([("a/b/e\u0301.cr3",), ("a/b/z.cr3",), ("a/b/y.cr3",), ("a/b/y.cr3",), (None,)], "path string").where("path is not null"))
    assert sorted((r.id, r.path) for r in got.collect())[2:] == [(5, "a/b/y.cr3"), (6, "a/b/z.cr3")] and got.count() == 4


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 1.0), ("b", 0, 2.0)], "path string, gen int, v double").write.parquet(source)
    stream = scoring.arriving(spark, source, "path string, gen int, v double")
    scoring.scored(stream, lambda df: df.withColumn("score", F.col("v") * 2), out, str(tmp_path / "cp"), 1).trigger(availableNow=True).start().awaitTermination()
    assert [(r.path, r.score) for r in scoring.standing(spark, out).collect()] == [("a", 2.0)]


def test_a_chunk_that_fails_is_skipped_and_the_pass_catches_up(spark, tmp_path):
    source, out, tried = (str(tmp_path / n) for n in ("in", "out", "tried"))
    kind, calls = "id long, path string, gen int", []
    for n in range(3):
        spark.createDataFrame([(n, f"p{n}", 1)], kind).coalesce(1).write.mode("append").parquet(source)

    def featurise(rows):
        calls.append(paths := [r.path for r in rows.collect()])
        if paths == ["p1"] or len(calls) == 1:  # p1 never works, the first chunk not at once
            raise ValueError("no such codec")
        return rows

    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    scoring.scored(stream, featurise, out, str(tmp_path / "cp"), 1, tried).trigger(availableNow=True).start().awaitTermination()
    assert {r.path for r in scoring.standing(spark, out).collect()} == {"p0", "p2"} and len(calls) == 3 + 2
    attempted = spark.read.parquet(tried)
    assert {(r.path, r.error is None) for r in attempted.collect()} == {("p0", True), ("p1", False), ("p2", True)}
    images = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id long, path string")
    left = scoring.to_catch_up(images, spark.createDataFrame([(4, "keep")], "img_id long, rating string"), scoring.standing(spark, out), attempted)
    assert sorted(r.path for r in left.collect()) == ["p3", "p5"]
    passes = []
    query = scoring.catching_up(spark.readStream.schema(kind).parquet(source), lambda: passes.append(left.count()), str(tmp_path / "cp2"), "300 milliseconds").start()
    query.processAllAvailable()
    query.stop()
    assert passes == [2]  # one for all three changes


def test_sidecar_sink(spark, tmp_path):
    path = str(tmp_path / "1.xmp")
    changes = spark.createDataFrame([(path, 1, "reject"), (path, 2, "favorite"), (str(tmp_path / "no" / "2.xmp"), 1, "keep")], "path string, seq bigint, rating string")
    for _ in range(2):
        got = {r.path: r.error for r in scoring.write_sidecars(changes, retries=(0.01,)).collect()}
        assert got[path] is None and "FileNotFoundError" in got[str(tmp_path / "no" / "2.xmp")]
    assert 'loom:fav="star"' in (tmp_path / "1.xmp").read_text()
