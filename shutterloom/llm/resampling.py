"""Importance resampling: draws documents so that their words are spread like those of a target collection.

Texts are bags of hashed features, runs of one or two words. The first pass over the documents and over the target
counts features by bucket, a vector of fixed length a partition from np.bincount, and treeReduce adds the vectors up
on executors. Each bucket's gain is the smoothed logarithm of its share in the target over its share in the
documents. The second pass gathers the broadcast gains of each document's features and sums them by document with
np.bincount. Gumbel noise from a hash of the id turns the largest scores into a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import ordered
from .common import WORD_BYTES, materialise, packed, texts, unpacked

#: Bytes of a text whose words are listed at once, at least; features that are counted or summed at once, at least.
PIECE, FLUSH = 1 << 20, 1 << 16


def word_lists(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    if len(text) <= size:
        yield text.translate(WORD_BYTES).split()
        return
    plain, at = text.translate(WORD_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def features(text: bytes, longest: int = 2, size: int = PIECE) -> Iterator[tuple[int, list[int]]]:
    """(words, CRC-32 of the features that end in them), for each list of words of a text."""
    tail: list[bytes] = []
    for ws in word_lists(text, size):
        old, ws = len(tail), tail + ws
        grams = [crc32(w) for w in ws]
        made = grams[old:]
        for n in range(2, longest + 1):
            # a run's checksum goes on from that of the run without its last word
            grams = [crc32(w, crc32(b" ", c)) for c, w in zip(grams, ws[n - 1 :])]
            made += grams[max(0, old - n + 1) :]
        yield len(ws) - old, made
        tail = ws[len(ws) - longest + 1 :] if longest > 1 else []


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(buckets, np.int64), []
        for batch in batches:
            for text in texts(batch.column(0)):
                for _, found in features(text or b"", longest):
                    held += found
                    if len(held) > FLUSH:
                        sums += np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
                        held = []
        sums += np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    vectors = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "sums binary").rdd.map(lambda row: np.frombuffer(row.sums, np.int64))
    # 80 kB a partition; the deeper tree keeps what one task or the driver adds up small for many thousand partitions
    return vectors.treeReduce(np.add, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def bucket_gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the documents, with one more in each bucket."""
    n, s, t = len(of_docs), int(of_docs.sum()), int(of_target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (float(s) + n) / ((float(a) + 1) * (float(t) + n)))) for a, b in zip(of_docs, of_target, strict=True)], np.int64)


_MADE = T.StructType([T.StructField(n, T.LongType()) for n in ("_words", "_features", "_weight")])


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = 2) -> DataFrame:
    """docs (_docs, _text) with _words, _features and _weight, the floored mean gain of the features, in place of _text."""
    sent = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n = batch.num_rows
            count, total, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            held, of = [], []

            def flush() -> None:
                nonlocal held, of, sums
                where = np.repeat(np.array([i for i, _ in of], np.int64), np.array([k for _, k in of], np.int64))
                sums += np.bincount(where, weights=gain[np.array(held, np.int64) % len(gain)], minlength=n)
                held, of = [], []

            for i, text in enumerate(texts(batch.column(1))):
                for more, found in features(text or b"", longest):
                    count[i] += more
                    total[i] += len(found)
                    held += found
                    of.append((i, len(found)))
                    if len(held) > FLUSH:
                        flush()
            flush()
            mean = np.where(total > 0, sums.astype(np.int64) // np.maximum(total, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(total), pa.array(mean)], ["_docs", *_MADE.names])

    return docs.mapInArrow(run, T.StructType([docs.schema["_docs"], *_MADE]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, from the first 8 hexadecimal digits of a SHA-256; a null id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text and others) with dsir_features, dsir_weight, dsir_score, dsir_rank (long); no row less.

    Of the documents with least_words words or more, floor(percent * their number / 100) are drawn, those of the highest
    scores, ties to the smaller doc_id, null last; dsir_rank numbers them from 1 in that order and is null for the
    others. ``keep`` names the columns to return, by default all; columns of those four names are replaced, others
    may have any name. Null and empty texts have no features, weight 0, and their noise as score. Repeated rows are a
    document each, in an arbitrary order among rows alike. Texts of any length are taken whole. With an empty target
    all gains come from the documents' own counts; an empty table gives an empty one.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("dsir_features", "dsir_weight", "dsir_score", "dsir_rank")]
    text = F.col("text").cast("string")
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = docs.select(F.struct(packed(docs, names), F.col("doc_id").cast("long").alias("id")).alias("_docs"), text.alias("_text"))
    rows = weighted(rows, gains, longest)
    able = F.col("_words") >= least_words
    rows = materialise(rows.withColumns({"_score": F.col("_weight") + gumbel(F.col("_docs.id"), seed), "_row": F.monotonically_increasing_id()}))
    # scores are whole numbers of a few ten thousand values, whatever the number of rows
    counts = sorted(rows.where(able).groupBy("_score").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    wanted, so_far, least = sum(r.n for r in counts) * percent // 100, 0, None
    for r in counts:
        if so_far < wanted:
            so_far, least = so_far + r.n, r._score
    first = able & (F.col("_score") >= least) if least is not None else F.lit(False)
    # only the drawn, and those that tie with the last of them, are sorted, over all tasks; _row leaves no ties
    drawn = ordered(rows.where(first), F.desc("_score"), F.col("_docs.id").asc_nulls_last(), F.col("_row"), name="_rank")
    rank = (F.col("_rank") + 1).cast("long")
    every = drawn.withColumn("_rank", F.when(rank <= wanted, rank)).unionByName(rows.where(~first).withColumn("_rank", F.lit(None).cast("long")))
    return every.select(*unpacked(names, "_docs._docs"), F.col("_features").alias("dsir_features"), F.col("_weight").alias("dsir_weight"), F.col("_score").alias("dsir_score"), F.col("_rank").alias("dsir_rank"))
