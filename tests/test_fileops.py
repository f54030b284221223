"""Moves, copies and trash that are committed as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from shutterloom.operators import storage, summaries
from shutterloom.plans import catalog
from shutterloom.sources import fileops


@pytest.fixture
def folder(tmp_path):
    for i, name in enumerate(("in/1.cr3", "in/1.xmp", "in/2.cr3", "in/3.cr3", "out/2.cr3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (1_600_000_000 + i, 1_600_000_000 + i))
    return tmp_path


def names(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def plan_of(spark, folder, *ids):
    rows = [(str(folder / f"in/{i}.cr3"), str(folder / f"out/{i}.cr3"), "do") for i in ids]
    return spark.createDataFrame(rows, "source string, dest string, action string").repartition(2)


@pytest.mark.parametrize("move", [False, True])
def test_a_plan_is_carried_out_and_times_are_kept(spark, folder, tmp_path_factory, move):
    journal = str(tmp_path_factory.mktemp("journal"))
    made = fileops.carry_out(plan_of(spark, folder, 1, 2, 3, 4), journal, move, "op")
    assert {(r.source[-5:], r.action, r.error) for r in made.collect()} == {("1.cr3", "do", None), ("2.cr3", "skip_exists", None), ("3.cr3", "do", None), ("4.cr3", "skip_missing", None)}
    left = ["in/2.cr3"] if move else ["in/1.cr3", "in/1.xmp", "in/2.cr3", "in/3.cr3"]
    assert names(folder) == left + ["out/1.cr3", "out/1.xmp", "out/2.cr3", "out/3.cr3"]
    assert [int(os.stat(folder / "out" / n).st_mtime) for n in ("1.cr3", "1.xmp", "3.cr3")] == [1_600_000_000, 1_600_000_001, 1_600_000_003]
    assert (folder / "out/2.cr3").read_text() == "out/2.cr3"
    total = storage.transfer_result(made).first()
    assert (total.done, total.skipped, total.failed) == (2, 2, 0)
    # again, after the commit: it goes on, and there is nothing left to do
    again = fileops.carry_out(plan_of(spark, folder, 1, 2, 3, 4), journal, move, "op")
    assert again.where("error is not null").count() == 0 and names(folder)[-4:] == ["out/1.cr3", "out/1.xmp", "out/2.cr3", "out/3.cr3"]


def test_an_aborted_run_leaves_nothing_half_done(spark, folder, tmp_path_factory):
    before = names(folder)
    journal = str(tmp_path_factory.mktemp("journal"))
    bad = plan_of(spark, folder, 1, 3).withColumn("action", F.when(F.col("source").endswith("3.cr3"), F.raise_error(F.lit("lost"))).otherwise(F.col("action")))
    rows = plan_of(spark, folder, 1).unionByName(bad.where("source like '%3.cr3'"))
    with pytest.raises(Exception, match="lost"):
        fileops.carry_out(rows.coalesce(1), journal, False, "op")
    # what a lost executor leaves
    (folder / "out/.1.cr3.op.part").write_text("half")
    assert fileops.rolled_back(spark, plan_of(spark, folder, 1, 3), "op") == 2
    assert names(folder) == before and not os.path.exists(f"{journal}/_committed")


def test_publishing_goes_on_after_a_stop(spark, folder, tmp_path_factory):
    journal = str(tmp_path_factory.mktemp("journal"))
    spark.dataSource.register(fileops.FileOperations)
    plan = plan_of(spark, folder, 1, 3)
    plan.write.format(fileops.SOURCE).mode("append").options(journal=journal, operation="op", move="false").save()
    assert "out/1.cr3" not in names(folder) and "out/.1.cr3.op.part" in names(folder)  # staged, in no one's way
    os.rename(folder / "out/.1.cr3.op.part", folder / "out/1.cr3")  # a task got so far
    fileops.carry_out(plan, journal, False, "op")
    assert names(folder)[-4:] == ["out/1.cr3", "out/1.xmp", "out/2.cr3", "out/3.cr3"]


def test_trash_has_its_accounting_and_gives_back(spark, folder, tmp_path_factory):
    before = names(folder)
    root = tmp_path_factory.mktemp("t")
    paths = spark.createDataFrame([(str(folder / n),) for n in ("in/1.cr3", "in/2.cr3", "in/9.cr3", "out/2.cr3", "in/1.cr3")] + [(None,)], "path string")
    stones = fileops.trashed(paths, str(root / "trash"), str(root / "j1"), "op1")
    total = storage.transfer_result(stones).first()
    assert (total.done, total.skipped, total.failed, total.errors) == (3, 1, 0, [])
    assert names(folder) == ["in/3.cr3"] and len(names(root / "trash")) == 4  # the sidecar went along
    assert {r.mtime_ms for r in stones.where("action = 'do'").collect()} == {1_600_000_000_000, 1_600_000_002_000, 1_600_000_004_000}
    fileops.carry_out(fileops.restore_plan(stones), str(root / "j2"), True, "op2")
    assert names(folder) == before


def test_summaries_of_parts_are_those_of_the_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, float(i * 37 % 1001)) for i in range(3000)] + [(8, None), (9, 5.0)], "k int, v double")
    for part in range(10):
        own = rows.where(F.pmod(F.hash("k", "v"), F.lit(10)) == part)
        for _ in range(2):  # a batch that is done again counts once
            summaries.keep(summaries.histogram(own, ["k"], F.col("v"), 64, 1000.0), str(tmp_path / "h"), part)
            summaries.keep(summaries.lowest(own, "k", "v"), str(tmp_path / "l"), part)
    found = summaries.spread(summaries.merged_histograms(summaries.kept(spark, str(tmp_path / "h")), ["k"]), ["k"], 64)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, storage.lower_percentiles(rows, ["k"], F.col("v"), 64, 1000.0).collect()))
    lows = summaries.merged_lowest(summaries.kept(spark, str(tmp_path / "l")), "k")
    assert sorted(map(tuple, summaries.noise_floor(lows, "k").collect())) == sorted(map(tuple, storage.lowest_median(rows, "k", "v").collect()))
    assert summaries.lowest(rows.limit(0), "k", "v").count() == 0


@pytest.mark.parametrize("name", ["noise_floors_of_parts", "histogram_spread_of_parts"])
def test_parts_are_summarised_in_one_pass_and_no_union_of_shuffles(spark, name):
    made = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_the_lowest_by_part_merge_to_those_of_the_whole(spark):
    rows = spark.createDataFrame([(i % 3, i % 7, float(i * 37 % 1001)) for i in range(3000)] + [(None, 1, 0.5), (0, 9, None)], "p int, k int, v double")
    merged = summaries.merged_lowest(summaries.lowest(rows, ["p", "k"], "v"), "k")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, summaries.lowest(rows, "k", "v").collect()))
