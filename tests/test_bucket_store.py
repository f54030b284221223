"""The feature store in bucketed segments."""

import pytest
from pyspark.sql import functions as F

from shutterloom.sources.store import BucketStore

ROW = "path string, mtime_ms long, bytes long, used long, version int, payload string"
FILES = "path string, mtime_ms long, bytes long"


def exchanges(plan):
    """Names of the tables below each exchange of a physical plan."""
    found = []

    def leaves(node):
        below = [x for i in range(node.children().size()) for x in leaves(node.children().apply(i))]
        return below or [node.toString()]

    def walk(node):
        if "Exchange" in node.nodeName():
            found.append(" ".join(leaves(node)))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


@pytest.fixture
def plain_joins(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_puts_add_their_own_rows_and_reads_do_not_shuffle_the_store(spark, tmp_path, plain_joins):
    store = BucketStore(spark, str(tmp_path / "s"), buckets=4, merge=3)
    rows = lambda *xs: spark.createDataFrame([(*x, "p" * x[2]) for x in xs], ROW)
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30), ("d", 4, 40), (None, 1, 1)], FILES)
    assert store.standing() is None and store.hits(files) is None and store.misses(files).count() == 5
    store.put(rows(("a", 1, 10, 5, 1), ("b", 1, 20, 6, 1), ("c", 3, 30, 7, 0), ("a", 0, 10, 9, 1)), 0)
    store.put(rows(("b", 2, 20, 8, 1), ("e", 9, 90, 9, 1)), 1, max_bytes=50)
    store.put(rows(("x", 9, 9, 9, 1)), 1)  # done already
    before = sorted(str(f) for f in (tmp_path / "s" / "segment=0").iterdir())
    hits, misses = store.hits(files), store.misses(files)
    assert sorted((r.path, r.mtime_ms) for r in hits.collect()) == [("a", 1), ("b", 2)]
    assert {r.path for r in misses.collect()} == {"c", "d", None}
    for df in (hits, misses):
        found = exchanges(df._jdf.queryExecution().executedPlan())
        assert found and not any("FileScan" in x for x in found), found
    # a newer row of a path replaces it even where it is stale
    store.put(rows(("a", 7, 10, 10, 1)), 2)
    assert {r.path for r in store.hits(files).collect()} == {"b"}
    assert sorted(str(f) for f in (tmp_path / "s" / "segment=0").iterdir()) == before
    with pytest.raises(Exception, match="disk"):
        store.put(rows(("z", 1, 1, 1, 1)).withColumn("payload", F.raise_error(F.lit("disk")).cast("string")), 3)
    assert store.manifest()["number"] == 2 and {r.path for r in store.standing().collect()} == {"a", "b", "c"}
    store.kept_within(55, 3)  # of 60 bytes, the least recently used go until 49.5 are left
    assert {r.path for r in store.standing().collect()} == {"a", "b"}
    store.put(rows(("c", 3, 30, 11, 1)), 4)  # back again, and five segments become one
    assert store.manifest()["buckets"]["segments"] == ["4-merged"]
    assert {(r.path, r.mtime_ms) for r in BucketStore(spark, str(tmp_path / "s"), 4).hits(files).collect()} == {("b", 2), ("c", 3)}


def test_what_is_missing_is_made_once_and_kept(spark, tmp_path):
    store, made = BucketStore(spark, str(tmp_path / "s"), buckets=2), spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], FILES)

    def featurise(missing):
        made.add(missing.count())
        return missing.withColumn("payload", F.concat(F.lit("of "), "path"))

    for number, (rows, count) in enumerate([(files, 2), (files, 2), (files.union(spark.createDataFrame([("b", 3, 20)], FILES)).where("path <> 'b' or mtime_ms = 3"), 3)]):
        got = store.acquired(rows, featurise, number)
        assert {(r.path, r.payload) for r in got.collect()} == {("a", "of a"), ("b", "of b")} and made.value == count
