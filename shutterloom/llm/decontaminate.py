"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, lower-cased and cut into words, make one automaton whose states stand for the word sequences that
occur in them. Documents stream through it word by word: the state and the length of the longest suffix that any
item has are all that is kept, so the work is linear in the text. Each time that length reaches a window, the
words under the window are hit and the state tells which items have it.

The automaton is broadcast. Items are taken in blocks of at most ``block_words`` words, so that what is sent to a
task is bounded whatever the benchmark's size; each further block is one more pass over the documents. All blocks
see the whole text, and what they find in a row is united before anything is judged or cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, materialise, packed, texts, unpacked, words

WINDOW = 10
#: Words of benchmark items in one automaton: some 300 bytes each on an executor.
BLOCK_WORDS = 1_000_000

_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("longest", T.LongType()),
        T.StructField("text_hash", T.LongType()),
    ]
)


class Automaton:
    """Generalised suffix automaton over words.

    ``out[s]`` lists, for state s, the (window length, items) that end wherever s is reached: windows are all
    runs of ``window`` words of an item, or a whole shorter item.
    """

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[dict[int, set[int]]] = [{}]
        ends: list[tuple[int, list[int]]] = []
        for item, ws in items:
            state, path = 0, []
            for w in ws:
                state = self._extend(state, w, own)
                path.append(state)
            ends.append((item, path))
        for item, path in ends:
            size = min(window, len(path))
            for end in path[size - 1 :] if path else ():
                # the window is a suffix of what ends here: the state on the link path whose lengths hold its length
                while self.length[self.link[end]] >= size:
                    end = self.link[end]
                own[end].setdefault(size, set()).add(item)
        self.out: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            new = tuple((n, tuple(sorted(x))) for n, x in sorted(own[s].items()))
            self.out[s] = self.out[self.link[s]] + new

    def _extend(self, last: int, w: bytes, own: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, own)
        cur = len(link)
        nxt.append({}), link.append(0), length.append(length[last] + 1), own.append({})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, own)
        return cur

    def _clone(self, p: int, w: bytes, q: int, own: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), own.append({})
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[int], set[int], int]:
        """Runs of hit words as start, end, start, end ...; the items found; the longest match in words."""
        nxt, link, length, out = self.next, self.link, self.length, self.out
        runs: list[int] = []
        items: set[int] = set()
        state = n = longest = 0
        for i, w in enumerate(ws, 1):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state = to
            n += 1
            if n > longest:
                longest = n
            if found := out[state]:
                for size, ids in found:
                    if size <= n:
                        items.update(ids)
                        start = i - size
                        while runs and runs[-2] >= start:
                            del runs[-2:]
                        if runs and runs[-1] >= start:
                            runs[-1] = i
                        else:
                            runs += start, i
        return runs, items, longest


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), in blocks of bounded size; items without words are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for row in items.where("text is not null").toLocalIterator(prefetchPartitions=False):
        if n := len(words(row.text.encode())):
            if block and size + n > block_words:
                yield block
                block, size = [], 0
            block.append((row.item_id, row.text))
            size += n
    if block:
        yield block


def _matches(docs: DataFrame, block: list[tuple[int, str]], window: int) -> DataFrame:
    """One row for each document: its words, hit runs (word numbers), items and longest match, for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(((i, words(t.encode())) for i, t in sent.value), window)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())), ("longest", pa.int64()), ("text_hash", pa.int64())])
        for batch in batches:
            ids, made = batch.column(0), ([], [], [], [])
            for text in texts(batch.column(1)):
                ws = words(text or b"")
                runs, items, longest = automaton.scan(ws)
                for column, value in zip(made, (len(ws), runs, sorted(items), longest), strict=True):
                    column.append(value)
            columns = [pa.array(x, f.type) for x, f in zip(made, list(schema)[1:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns, batch.column(2)], schema=schema)

    return docs.mapInArrow(scan, _FOUND)


def united(runs: Iterable[list[int]]) -> list[int]:
    """Runs (start, end, start, end ...) of several blocks as one such list; runs that meet or overlap are one."""
    made: list[int] = []
    for start, end in sorted(p for r in runs for p in zip(r[::2], r[1::2], strict=True)):
        if made and start <= made[-1]:
            made[-1] = max(made[-1], end)
        else:
            made += start, end
    return made


def _united(found: DataFrame) -> DataFrame:
    """What several blocks found as one row for each ``doc_id``, which must tell rows apart."""
    found = found.groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"), F.first("text_hash").alias("text_hash"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "runs", pa.array([united(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int64())))

    return found.mapInArrow(run, _FOUND)


def _in_blocks(numbered: DataFrame, blocks: Iterable[list[tuple[int, str]]], window: int) -> DataFrame:
    """matches() of rows (_row, text), all blocks united, with _row as doc_id."""
    docs = numbered.select(F.col("_row").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = None
    for block in blocks:
        one = _matches(docs, block, window)
        found = one if found is None else found.unionByName(one)
    return _united(found)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs in a table, with a number _row that tells all rows apart, also those that are alike."""
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()))


def _few(benchmark: DataFrame, block_words: int) -> tuple[list[list[tuple[int, str]]], bool]:
    """The first two blocks of items at most, and whether they are more than one."""
    first = list(itertools.islice(item_blocks(benchmark, block_words), 2))
    return first[:1], len(first) > 1


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, runs, items, longest, text_hash.

    ``runs`` holds the hit words as start, end, start, end ... (ends exclusive), ``items`` the sorted item_ids with
    a window in the text, ``longest`` the longest run of words that any item has. A null or empty text has no words.
    Repeated rows give a row each. More than one block of items takes a pass for each, over a table of the rows in
    which each has a number.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, more = _few(benchmark, block_words)
    if not more:
        return _matches(docs.withColumn("text_hash", F.xxhash64("text")), first[0] if first else [], window)
    numbered = _numbered(docs)
    found = _in_blocks(numbered, item_blocks(benchmark, block_words), window).withColumnRenamed("doc_id", "_row")
    return numbered.select("_row", "doc_id").join(found, "_row").select(*_FOUND.names)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage, longest: one row for each row of docs.

    items_sha256 is the SHA-256 of the matched item_ids, sorted as strings and joined by commas.
    """
    found = matches(docs, benchmark, window, block_words)
    hit = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))["sum"]
    found = found.withColumn("n_hit", hit.cast("long"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0)).alias("coverage"), "longest",
    )


def _cut(text: bytes, runs: list[int]) -> bytes:
    """The text without the words of the runs and what stands between them."""
    plain, kept, at, word, run = text.translate(WORD_BYTES), [], 0, 0, 0
    pos = 0
    for w in plain.split():
        pos = plain.index(w, pos)
        if run < len(runs) and word == runs[run]:
            kept.append(text[at:pos])
        pos += len(w)
        word += 1
        if run < len(runs) and word == runs[run + 1]:
            at, run = pos, run + 2
    kept.append(text[at:])
    return b"".join(kept)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the benchmark's passages, all columns kept.

    Words under a matched window are cut out of the text; a document of which more than ``max_coverage`` is hit goes
    altogether. Clean documents, null and empty texts pass unchanged; repeated rows
    are treated alike, other columns may have any name. ``n_chars``, if there, is counted anew for
    texts that were cut. Several blocks of items take a pass each over the whole texts; what they find is united
    before coverage is tested and passages are cut.
    """
    names = docs.columns
    first, more = _few(benchmark, block_words)
    if not first:
        return docs
    rows = docs.select(packed(docs, names, "_all"))
    sent = docs.sparkSession.sparkContext.broadcast(first[0])
    at, known = names.index("text"), more
    if more:
        numbered = _numbered(docs.select(packed(docs, names, "_all"), "text"))
        found = _in_blocks(numbered, item_blocks(benchmark, block_words), window).where(F.size("runs") > 0).select(F.col("doc_id").alias("_row"), F.col("runs").alias("_runs"))
        rows = numbered.join(found, "_row", "left").select("_all", "_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None if known else Automaton(((i, words(t.encode())) for i, t in sent.value), window)
        for batch in batches:
            kinds = list(batch.schema.field(0).type)
            columns = [batch.column(0).field(i) for i in range(len(names))]
            given = batch.column(1).to_pylist() if known else [None] * batch.num_rows
            keep, made, changed = [], [], []
            for text, runs in zip(texts(columns[at]), given, strict=True):
                ws = words(text or b"") if runs or not known else []
                runs = runs or [] if known else automaton.scan(ws)[0]
                hit = sum(runs[1::2]) - sum(runs[::2])
                keep.append(not hit or hit <= max_coverage * len(ws))
                changed.append(bool(hit))
                made.append(_cut(text, runs) if hit else text)
            columns[at] = pa.array(made, pa.binary()).cast(kinds[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                new = pa.array([len(t.decode()) if c else None for t, c in zip(made, changed, strict=True)], pa.int64())
                columns[k] = pa.compute.coalesce(new.cast(kinds[k].type), columns[k])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=kinds)], ["_all"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(cut, T.StructType([rows.schema["_all"]])).select(*unpacked(names, "_all"))
