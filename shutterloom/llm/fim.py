"""Fill-in-middle: a text is cut at two token boundaries and rearranged, so that a model learns to fill the gap.

Tokens are runs of ASCII letters and single other characters. The tokenizers library's Split pre-tokenizer, which
needs no training, isolates each match of their pattern and tells its code points: the number of offsets is the
number of tokens, and the offsets at two drawn ranks are the places of the cuts. A long text goes through it in
pieces that end right after a character that is a token by itself, where no token can be cut in two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import packed, unpacked

TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a text that are cut into tokens at once, at least.
PIECE = 4096
#: Code points of output after which rows are handed to Spark.
FLUSH = 1 << 21
_ALONE = re.compile("[^A-Za-z]")
_MADE = {"fim_n": T.LongType(), "fim_form": T.StringType(), "fim_prefix_chars": T.LongType(), "fim_middle_chars": T.LongType(), "fim_output": T.StringType()}


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """The text in pieces (place, piece) of ``size`` code points or more, none of which ends within a token."""
    at = 0
    while at < len(text):
        alone = _ALONE.search(text, at + size - 1) if len(text) - at > size else None
        end = alone.end() if alone else len(text)
        yield at, text[at:end]
        at = end


def offsets(split: Split, text: str, size: int = PIECE) -> np.ndarray:
    """The place of each token in code points, and the length of the text after them."""
    starts = [np.array([span[0] for _, span in split.pre_tokenize_str(piece)], dtype=np.int64) + at for at, piece in pieces(text, size)]
    return np.concatenate([*starts, [len(text)]])


def _arranged(text: str, form: str, first: int, last: int) -> str:
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """docs (doc_id, text and others) with fim_n, fim_form, fim_prefix_chars, fim_middle_chars, fim_output.

    fim_form is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle). What is drawn
    for a row is taken from the SHA-256 of ``seed:doc_id``, so repeated rows and ids are treated alike; a null doc_id
    counts as an empty string there. A null text counts as empty; an empty text and one that holds a sentinel stay
    plain, with null in fim_prefix_chars and fim_middle_chars. Texts of any length are cut into tokens as a whole, in
    pieces. An empty table gives an empty one. All other columns are kept, of whatever name; columns of docs of the five
    names are replaced.
    """
    names = [c for c in docs.columns if c not in _MADE]
    at = names.index("text")
    rows = docs.select(packed(docs, names), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(TOKEN), "isolated")
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            taken, done, size = [], 0, 0
            for i, (text, digest) in enumerate(zip(batch.column(0).field(at), batch.column(1).to_pylist(), strict=True), 1):
                text = text.as_py() or ""
                ends = offsets(split, text)
                n = len(ends) - 1
                h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
                if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= fim_percent:
                    taken.append((n, "plain", None, None, text))
                else:
                    first, last = (int(ends[rank]) for rank in sorted(x % (n + 1) for x in h[:2]))
                    form = "spm" if h[3] % 100 < spm_percent else "psm"
                    taken.append((n, form, first, last - first, _arranged(text, form, first, last)))
                size += len(text)
                if size > FLUSH or i == batch.num_rows:
                    made = [pa.array(x, t) for x, t in zip(zip(*taken, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(taken)), *made], ["_docs", *_MADE])
                    taken, done, size = [], i, 0

    schema = T.StructType([rows.schema["_docs"], *[T.StructField(n, t) for n, t in _MADE.items()]])
    return rows.mapInArrow(run, schema).select(*unpacked(names), *_MADE)


def restored(form: Column, output: Column) -> Column:
    """The text from which transform() made ``output``. A sentinel is in an arranged output once, as no text that holds one is arranged."""

    def between(first: str, second: str) -> Column:
        return F.substring_index(F.substring_index(output, second, 1), first, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
