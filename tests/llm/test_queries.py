"""The registered queries against their SQL on the smallest tables, and that all run."""

import os

import duckdb
import pytest

from shutterloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(queries.oracle_sql()[name])
    have = [d[0] for d in want.description]
    assert sorted(have) == names
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[have.index(c)] for c in names) for r in want.fetchall())


def test_languages_of_held_out_documents(spark):
    """Accuracy on the documents that taught nothing."""
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op9_langid(spark, SF).join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
