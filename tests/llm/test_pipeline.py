"""The pipeline's stages on odd rows, and as a whole."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import langid, licenses, secrets

from .test_text_operators import ODD, docs


def test_stages_keep_clean_rows_and_columns(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = "The quick brown fox number {} jumps over many lazy dogs while rain falls on the old town and {} sleeps"
    rows = [(100 + i, clean.format(i * 7, i), "en", "s", 80) for i in range(5)]
    rows += [(200, clean.format("x", "y"), "en", "s", 80), (201, clean.format("x", "y"), "en", "t", 80), (202, f"before {clean.format(1, 2)} {item} after", "en", "s", 9), (203, item, "en", "s", 9), (204, "my words here token = 0123456789abcdef0123456789", "en", "s", 9)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in got.where("doc_id >= 100").collect()}
    assert set(kept) == {100, 101, 102, 103, 104, 200, 202, 204} and all(kept[i] == rows[i - 100][1] for i in range(100, 105))
    assert item not in kept[202] and kept[202].startswith("before") and kept[204] == "my words here [SECRET]"
    assert got.where("text is null or text = ''").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == got.count() == whole.select("mix_order").distinct().count()
    assert {r.doc_id for r in whole.where(F.col("doc_id") < 100).collect()} == {3, 4, 5}
    assert len(ODD) == 8


def test_empty_documents(spark, tmp_path):
    docs(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that steps of the stages have had, or that need quoting.
CLASH = ("a.b", "_base", "_more", "found", "_clean", "_source", "_hash", "_rank", "_block", "_row", "lang_pred", "lang_ambiguous", "_docs", "_all", "_runs", "_one", "_text", "_share", "back`tick")


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_hand_on_columns_of_any_name(spark, tmp_path, stage):
    item = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(100 + i, f"the quick brown fox number {i} runs over the hills and {i * 7} sheep while it rains on the old town", "en", "s", 80) for i in range(6)]
    rows += [(200, f"before all of these other words here come some more of them {item} after", "en", "s", 9), (201, "my words here token = 0123456789abcdef0123456789", "en", "t", 9)]
    table = docs(spark, rows).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in CLASH})
    name, run = corpus_pipeline.STAGES[stage]
    made = run(spark, table, str(tmp_path))
    assert made.columns[: len(table.columns)] == table.columns
    got = made.collect()
    assert {r.doc_id for r in got} >= {*range(100, 106), 200, 201}
    assert all(r[c] == f"{c}:{-1 if r.doc_id is None else r.doc_id}" for r in got for c in CLASH)
    texts = {r.doc_id: r.text for r in got}
    assert (item in texts[200]) == (name != "decontamination") and ("[SECRET]" in texts[201]) == (name == "secret_scan")


def test_scans_hand_on_columns_of_any_name(spark):
    table = docs(spark).withColumns({c: F.lit(c) for c in CLASH if c != "found"})
    samples = secrets.default_samples(docs(spark))
    for got in (licenses.scan(table), secrets.scan(table, samples), langid.predict(table.drop("lang_pred", "lang_ambiguous"), langid.fit(docs(spark)))):
        rows = got.collect()
        assert len(rows) == table.count() and all(r[c] == c for r in rows for c in CLASH if c not in ("found", "lang_pred", "lang_ambiguous"))
