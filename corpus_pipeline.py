"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder
and reads them as the next one's docs. Every stage works on all rows that its predecessor kept. All but the last
return the columns of documents, and each copes with null or empty texts, null columns, repeated rows, empty tables
and further columns of any name, whose values it hands on, as its operator's docstring says; mixing alone replaces
columns that are named mix_block, mix_release, mix_deadline or mix_order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import decontaminate, langid, mixing, neardup, secrets
from shutterloom.llm.common import discard, materialise, packed, table, unpacked

#: An ambiguous text of so many characters goes: it is in no one language.
AMBIGUOUS_CHARS = 200


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null or without a letter, and longer ones that the language classifier finds ambiguous."""
    # the caller's columns in one, so that none of theirs is taken for a prediction
    found = langid.predict(docs.select(packed(docs), "text"), langid.fit(docs))
    odd = F.col("lang_ambiguous") & (F.length("text") >= AMBIGUOUS_CHARS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~odd).select(*unpacked(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest doc_id; of rows alike in doc_id and text just one."""
    classes = neardup.classify(docs, width=5, percent=80)
    kept = classes.where("kept").select(F.col("row_key").alias("_row")).distinct()
    # repeated rows become one before they are shuffled, however many there are; the one is chosen by its other columns
    whole = packed(docs)
    rows = docs.groupBy(neardup.row_key().alias("_row")).agg(F.min_by(whole, F.xxhash64(whole)).alias("_one"))
    return rows.join(kept, "_row", "left_semi").select(*unpacked(docs.columns, "_one"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ten words or more of benchmark items; drops documents that are mostly such."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its place in a stream that mixes the sources by tempered weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secret_scan", secret_spans),
    ("mixing", mixture),
]

#: The language classifier and the hash sketches have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
            if i:  # a stage's rows are in a table, so the one before is read no more
                discard(before)
    return docs
