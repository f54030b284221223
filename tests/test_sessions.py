"""Streams with state against the batch results."""

import time

import pytest

from shutterloom.operators import history
from shutterloom.streaming import scoring, sessions

from .test_journal import ACTIONS, log, stack


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get(sessions.ROCKSDB[0])
    spark.conf.set(*sessions.ROCKSDB)
    yield
    spark.conf.set(sessions.ROCKSDB[0], before)


def stream_of(spark, path, kind, parts, at=0):
    for n, rows in enumerate(parts, at):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files go by their time
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stream_in_ten_batches_equals_the_batch(spark, tmp_path):
    rows = [(r[0] or 9, *r[1:]) for r in log(7, 260, 4)]
    stream = stream_of(spark, str(tmp_path / "in"), ACTIONS, [rows[i : i + 26] for i in range(0, 260, 26)])
    made = sessions.rating_stream(stream, depth=6)
    query = made.writeStream.format("memory").queryName("effects").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 10
    got = sorted(map(tuple, spark.table("effects").collect()), key=repr)
    assert got == stack(rows, 6) == sorted(map(tuple, history.effects(spark.createDataFrame(rows, ACTIONS), 6).collect()), key=repr)


def test_a_stream_goes_on_from_an_initial_state(spark, tmp_path):
    rows = [(1, 1, "undo", None), (1, 2, "redo", None), (1, 3, "redo", None), (1, 4, "redo", None), (2, 5, "undo", None), (1, 6, "rate", [(9, None, "keep")]), (1, 7, "redo", None)]
    kind = "session long, undo array<array<struct<img_id:long,before:string,after:string>>>, redo array<array<struct<img_id:long,before:string,after:string>>>"
    first = spark.createDataFrame([(1, [[(5, None, "keep")], [(6, "keep", "reject")]], [[(8, None, "a")], [(7, None, "b"), (7, "b", None)]])], kind)
    stream = stream_of(spark, str(tmp_path / "in"), ACTIONS, [rows])
    query = sessions.rating_stream(stream, first).writeStream.format("memory").queryName("going_on").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r)[1:] for r in spark.table("going_on").collect())
    assert got == [(1, 0, 6, "keep"), (2, 0, 6, "reject"), (3, 0, 7, "b"), (3, 1, 7, None), (4, 0, 8, "a"), (6, 0, 9, "keep")]


def test_writes_wait_in_turn_and_others_go_on(spark, tmp_path):
    tries = tmp_path / "tries"
    tries.mkdir()

    def write(path, rating):
        # a file for each try; b never works, a works from the third try on
        n = sum(f.name.startswith(f"{path}-") for f in tries.iterdir())
        (tries / f"{path}-{n:03d}-{rating}").write_text(str(time.time()))
        if path == "b" or path == "a" and n < 2:
            raise OSError("share is gone")

    kind = "path string, seq long, rating string"
    first = [("a", 1, "keep"), ("a", 2, "reject"), ("b", 1, "keep"), ("b", 2, None), ("c", 1, "keep"), (None, 1, "keep")]
    source = str(tmp_path / "in")
    waits = (400, 1500, 4000)
    made = sessions.write_queue(stream_of(spark, source, kind, [first]), write, waits)
    query = made.writeStream.format("memory").queryName("outcomes").outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("outcomes").where("path = 'b'").count() < 2:
            time.sleep(0.5)
            if spark.table("outcomes").where("path = 'c'").count() == 1:
                stream_of(spark, source, kind, [[("c", 2, "favorite"), ("c", 1, "keep")]])  # and an old one again
        assert query.exception() is None
    finally:
        query.stop()
    got = spark.table("outcomes").collect()
    assert [(r.seq, r.rating, r.state, r.tries) for r in got if r.path == "a"] == [(1, "keep", "saved", 3), (2, "reject", "saved", 1)]
    assert [(r.seq, r.state, r.tries) for r in got if r.path == "b"] == [(1, "superseded", 4), (2, "failed", 4)]
    assert [(r.seq, r.rating, r.state) for r in got if r.path == "c"] == [(1, "keep", "saved"), (2, "favorite", "saved")]
    assert [tuple(r) for r in sessions.unsaved(spark.table("outcomes")).collect()] == [("b", 2, None)]
    at = {p: [float(f.read_text()) for f in sorted(tries.glob(f"{p}-*"))] for p in "abc"}
    assert len(at["b"]) == 8
    for start in (0, 4):
        gaps = [1000 * (z - a) for a, z in zip(at["b"][start:], at["b"][start + 1 : start + 4])]
        assert all(gap >= wait - 150 for gap, wait in zip(gaps, waits, strict=True))
    assert max(at["c"]) < min(at["b"][4:])  # c did not wait for b


def test_sidecars_by_the_queue(spark, tmp_path):
    path = str(tmp_path / "1.xmp")
    stream = stream_of(spark, str(tmp_path / "in"), "path string, seq long, rating string", [[(path, 1, "reject"), (path, 2, "favorite")]])
    query = sessions.write_queue(stream, scoring.writer()).writeStream.format("memory").queryName("sidecars").outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("sidecars").count() < 2:
            time.sleep(0.3)
    finally:
        query.stop()
    assert [(r.seq, r.state) for r in spark.table("sidecars").orderBy("seq").collect()] == [(1, "saved"), (2, "saved")]
    assert 'loom:fav="star"' in (tmp_path / "1.xmp").read_text()
