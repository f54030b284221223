"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier for each bit, a naive Bayes over hashed byte trigrams, tells the
languages whose codeword has a one there from the others. A text's bit margins are decoded to the codeword with the
least loss; bits weigh as much as their classifiers get right. Where the best two codewords are close, the text is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import packed, texts, unpacked

#: Trigram buckets.
BUCKETS = 8192
#: a-z and bytes from 0x80 as they are, A-Z lower-cased, all else as one mark.
_LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 1 for b in range(256)], dtype=np.int32)
UNKNOWN = "und"


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text; runs of marks count as one."""
    a = _LETTERS[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    mark = a == 1
    a = a[1:][~(mark[1:] & mark[:-1])]
    if len(a) < 3:
        return np.zeros(BUCKETS, dtype=np.int64)
    return np.bincount(((a[:-2] * 977 + a[1:-1]) * 389 + a[2:]) % BUCKETS, minlength=BUCKETS)


def has_letter(text: bytes) -> bool:
    a = _LETTERS[np.frombuffer(text, dtype=np.uint8)]
    if ((a >= 0x61) & (a <= 0x7A)).any():
        return True
    return bool((a >= 0x80).any()) and any(c.isalpha() for c in text.decode(errors="replace"))


def codewords(n: int, bits: int = 15, seed: int = 5) -> np.ndarray:
    """n codewords of -1 and 1: all useful splits for up to 5 languages, else random ones far apart.

    Every bit splits the languages in two, none of them empty.
    """
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1] + [1 if not s >> i & 1 else -1 for i in range(n - 1)] for s in splits], dtype=np.int8).T
    rng, best, far = np.random.default_rng(seed), None, (-1, -1.0)
    bits = max(bits, int(np.ceil(10 * np.log2(n))))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) / 2
        least = apart[np.triu_indices(n, 1)]
        if (least.min(), least.mean()) > far:
            best, far = code, (least.min(), least.mean())
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # trigram bucket x bit: log odds
    bit_weight: np.ndarray
    scale: float

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """For each language, the weighted loss of its codeword against the margins of the text."""
        n = counts.sum()
        margins = counts @ self.weights / max(1.0, np.sqrt(n)) * self.scale
        return np.log1p(np.exp(-np.clip(margins[None, :] * self.code, -50, 50))) @ self.bit_weight

    def predict(self, text: bytes | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, lead over the second best; no letter or no model: und, 0, 0."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        losses = self.losses(trigrams(text))
        best = int(losses.argmin())
        p = np.exp(losses[best] - losses)
        p /= p.sum()
        lead = p[best] - max(np.delete(p, best), default=0.0)
        return self.langs[best], float(p[best]), float(lead)


def fit(labelled: DataFrame, per_language: int = 1500) -> Model:
    """A model from (doc_id, text, lang) rows.

    At most ``per_language`` documents train each language, those with the smallest hashes of doc_id (of ties, the
    smallest ids); rows of one doc_id and language all count. Rows with a null in doc_id, text or lang train nothing;
    no rows give a model that answers und. Other columns are not read.
    """
    labelled = labelled.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "lang", "text")
    sizes = F.broadcast(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_rows")))  # a row for each language
    # hashes are even, so the smallest are below a cut that leaves some more than are wanted: only those meet in a task
    hash_ = F.xxhash64("doc_id")
    share = F.shiftrightunsigned(hash_, 11) / float(1 << 53)
    order = F.when(hash_ < 0, share - 0.5).otherwise(share + 0.5)  # the place of a signed hash, from 0 to 1
    near = labelled.select("doc_id", "lang").join(sizes, F.col("lang") == F.col("_lang")).where(order <= (1.2 * per_language + 200) / F.col("_rows"))
    first = F.dense_rank().over(Window.partitionBy("lang").orderBy(hash_, "doc_id"))
    chosen = near.withColumn("_n", first).where(F.col("_n") <= per_language).select("doc_id", "lang").distinct()
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                sums[lang] = sums.get(lang, 0) + trigrams(text)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "counts"])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    sums: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, kind).toLocalIterator():  # 8 tasks, one row of a fixed size for each language
        sums[row.lang] = sums.get(row.lang, 0) + np.array(row.counts)
    return model({k: v for k, v in sums.items() if v.sum()})


def model(sums: dict[str, np.ndarray]) -> Model:
    """A model from each language's trigram counts; every language counts alike, however much text it has."""
    langs = sorted(sums)
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((BUCKETS, 1)), np.ones(1), 1.0)
    p = np.stack([(sums[x] + 0.5) / (sums[x].sum() + 0.5 * BUCKETS) for x in langs])
    if len(langs) == 1:
        return Model(langs, code, np.zeros((BUCKETS, 1)), np.ones(1), 1.0)
    weights = np.stack([np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0)) for bit in code.T], axis=1)
    # how surely each bit's classifier tells the languages' own trigrams apart
    sure = (p @ weights * code).min(axis=0)
    bit_weight = np.maximum(sure, 1e-3)
    return Model(langs, code, weights, bit_weight / bit_weight.mean(), 1.0)


def held_out(modulus: int, remainder: int):
    """crc32(doc_id as text) mod modulus = remainder; false for a null doc_id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def predict(docs: DataFrame, fitted: Model, ambiguous_lead: float = 0.1) -> DataFrame:
    """docs, all columns and rows kept, with lang_pred, lang_score and lang_ambiguous (replacing columns of those names).

    Only the text is looked at; other columns may have any name. A null text or one without a letter is und with score 0, and not ambiguous.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous")]
    docs = docs.select(packed(docs, names))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())]
    sent, at = docs.sparkSession.sparkContext.broadcast(fitted), names.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sent.value
        for batch in batches:
            found = [use.predict(t) for t in texts(batch.column(0).field(at))]
            lang, score, lead = zip(*found, strict=True) if found else ((), (), ())
            close = [x != UNKNOWN and y < ambiguous_lead for x, y in zip(lang, lead, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["_docs", "lang_pred", "lang_score", "lang_ambiguous"])

    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, *more])).select(*unpacked(names), "lang_pred", "lang_score", "lang_ambiguous")
