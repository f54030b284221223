"""Language-model scoring with a hierarchical Pitman-Yor process.

A word is drawn from the restaurant of the word before it, or of the start of a text; each word has one. All of these
restaurants share one parent, the restaurant of words without a context. The base measure of that one spells a word
byte by byte: restaurants for three preceding letter classes, which share parents for two, which share parents for one,
then a root over bytes, then the uniform measure. Each table of a restaurant is a customer of its parent. Contexts may
be limited to the most frequent words; after others a word is then drawn from the parent at once.

Seating starts as in a Chinese restaurant and is then sampled by Gibbs: a customer of each dish leaves, and takes its
table with it if it sat alone there, and sits down again by the posterior, MOVES times a sweep. A restaurant's state is
the count of customers and tables of each dish; how likely a customer sits alone follows from these by generalised
Stirling numbers. A pair of words is a row. Pairs that come once in all texts have one customer at one table whatever
is drawn, so they are only counted: what a word's count has beyond its other pairs are such. Pairs and words that come
once in training have one table too, so only the others are drawn; spelling gives what the rare words' predictions need
of all sweeps in one pass. Sweeps draw the tables of all pairs, given the totals and predictions of the sweep before,
and then those of their parent. What each restaurant predicts is averaged over the sweeps.

Words and pairs grow with the corpus and stay distributed. The spelling model has at most 32 ** 3 * 257 cells, whatever
the corpus, so it is broadcast. The at most HEAD most frequent words have numbers, by which Python tasks look them up in
broadcast arrays; other words are known by 64-bit keys and looked up by joins. In sweeps a pair with one word of each kind
joins with the HOT most frequent by broadcast, which takes the hot keys away. Scoring also has the at most PAIRED most
frequent pairs of numbered words.

Pairs, and what texts ask of words and pairs, are many short rows of numbers. They lie and travel as blocks of buckets by
their keys: a task makes one row of what it has for a bucket, and the bucket's rows meet in numpy (blocks.py).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import mix as _mix
from .common import discard, materialise, texts, tokens

#: The end of a text as a token: no word holds a space.
END = b" "
CONTEXTS = None  # words with a restaurant of what follows them, beside the start: all
HEAD = 300_000  # the most frequent words that are broadcast to Python tasks, at most
HOT = 30_000  # those of them that joins broadcast
PAIRED = 1_000_000  # the most frequent pairs of them that are broadcast for scoring, at most
PARTS = 4  # of the texts, scored one after another, so that few of their rows lie on disk at once
SWEEPS = 3
MOVES = 4  # of each dish, in a sweep
_FLUSH = 600_000  # distinct words of parts of texts that a task holds
_TEXTS = 1_000_000  # bytes of such a part
_TOKENS = 4_000_000  # of texts that a task counts at once, at most, and of the last one
_BUCKET = 750_000  # tokens to a bucket; beyond 1000 buckets their size grows too, by the root, as each task has a block for each
_SLICE = 16_384  # numbers of words whose sums meet in one task
_BLOCKS = 16  # blocks that Python gets at once
#: Kinds of blocks, and their columns. Of pairs: counted, CORE of two numbered words, whose numbers are one code.
CORE, REST, STATE, SUMS, TWOS = range(5)
#: Of scoring: words without a number; what texts ask for: a numbered pair, a word, a context, another pair; what they get; and a text.
WORDS, NEAR, WORD, CONTEXT, PAIR, OF_PAIR, OF_WORD, TEXT = range(5, 13)
_COUNTED, _STATE, _PAIRS = {CORE: "qqq", REST: "qqqq"}, "qqqqi", {CORE: "qqd", REST: "qqqd"}
_ASKED = {WORDS: "qddd", NEAR: "qq", WORD: "qqqb", CONTEXT: "qqqdb", PAIR: "qqqdddb", OF_PAIR: "qd", OF_WORD: "qdd", TEXT: "qqqbdddd"}
_TRAINS, _FREE = 1, 2  # flags of a word that a text asks for: the text is a training text; the word has no context
_NEAR_TRAINS = 1 << 62  # the flag in a code
_ASKS = 1_000_000  # held by a task at once, at most, and those of the last texts
_STOP = 256  # the end of a word's spelling, beside the 256 bytes
_DISHES = 257
#: Letter classes of bytes: a-z 0-25, digits 26, other ASCII 27, first bytes of longer characters 28-29, later ones 30, start 31.
_CLASS = np.array([b - 0x61 if 0x61 <= b <= 0x7A else 26 if 0x30 <= b <= 0x39 else 27 if b < 0x80 else 30 if b < 0xC0 else 28 if b < 0xE0 else 29 for b in range(256)] + [31], dtype=np.int64)
_START = 31


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A uniform number for each key and step, the same whenever a task is run again."""
    return (_mix(key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(count: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish by Chinese-restaurant seating: customer i + 1 opens one with mass / (mass + i - discount * t).

    mass is (strength + discount * all tables) * base probability. The first 32 customers sit one by one, later ones
    in blocks of an eighth of those seated, by randomised rounding of the expected number.
    """
    tables = np.minimum(count, 1).astype(np.float64)
    live, i, step = np.flatnonzero(count > 1), 1, 0
    while len(live):
        block = np.minimum(max(1, i // 8) if i >= 32 else 1, count[live] - i)
        m, t = mass[live], tables[live]
        p = m / (m + i + (block - 1) / 2 - discount * t)
        new = np.floor(block * p + _uniform(key[live], step))
        tables[live] = np.minimum(t + new, count[live])
        i += max(1, i // 8) if i >= 32 else 1
        step += 1
        live = live[count[live] > i]
    return tables


_EXACT = 512


@functools.lru_cache(maxsize=8)
def _alone(discount: float) -> np.ndarray:
    """S(c - 1, t - 1) / S(c, t) of the generalised Stirling numbers, for up to _EXACT customers c and tables t."""
    log_s, made = np.full(_EXACT + 1, -np.inf), np.zeros((_EXACT + 1, _EXACT + 1))
    log_s[0] = 0.0
    tables = np.arange(_EXACT + 1)
    for c in range(1, _EXACT + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            joined = np.where(tables < c, np.log(np.maximum(c - 1 - discount * tables, 0)) + log_s, -np.inf)
            opened = np.concatenate(([-np.inf], log_s[:-1]))
            log_s = np.logaddexp(joined, opened)
            made[c, 1 : c + 1] = np.exp(opened - log_s)[1 : c + 1]
    return made


def alone(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The chance that one of ``count`` customers at ``tables`` tables sits alone.

    Beyond _EXACT customers the chance for a table to have one customer is that of _EXACT customers at as many times
    count ** discount tables, which it tends to depend on alone.
    """
    known, c = _alone(discount), np.minimum(count, _EXACT)
    share = (c / np.maximum(count, 1)) ** discount
    t = np.clip(tables * share, np.minimum(tables, 1), c)
    low = np.floor(t).astype(np.int64)
    c = c.astype(np.int64)
    p = known[c, low] + (t - low) * (known[c, np.minimum(low + 1, c)] - known[c, low])
    return np.clip(p * c / np.maximum(count, 1) / np.maximum(share, 1e-300), 0.0, 1.0)


def reseat(count: np.ndarray, tables: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray, moves: int = MOVES) -> np.ndarray:
    """Tables after Gibbs moves: in each a customer of each dish leaves, with its table if it sat alone, and sits down
    again at a new table with chance mass / (mass + other customers - discount * their tables)."""
    tables = tables.copy()
    live = np.flatnonzero(count > 1)  # a single customer has its table
    c, m, k, t = count[live], mass[live], key[live], tables[live]
    for move in range(moves if len(live) else 0):
        t = t - (_uniform(k, 2 * move) < alone(c, t, discount))
        t = t + (_uniform(k, 2 * move + 1) < m / (m + c - 1 - discount * t))
    tables[live] = t
    return tables


@dataclass
class Spelling:
    """Predictive probabilities of bytes: cells of the third level over a dense second level."""

    cells: np.ndarray  # sorted context * 257 + dish
    own: np.ndarray  # (customers - discount * tables) / (strength + all customers)
    back: np.ndarray  # by context of the third level: the weight of its parent
    parent: np.ndarray  # 32 * 32 x 257

    def log_p(self, symbols: np.ndarray, context: np.ndarray) -> np.ndarray:
        cell = context * _DISHES + symbols
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            own = np.where(self.cells[at] == cell, self.own[at], 0.0)
        else:
            own = 0.0
        return np.log(own + self.back[context] * self.parent[context % 1024, symbols])

    def log_words(self, words: list[bytes], letters: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Of words, whose spelled() letters may be given."""
        symbols, context, of = letters or spelled(words)
        return np.bincount(of, self.log_p(symbols, context), len(words))


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the words, each with its context of three classes, and the number of its word."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    symbols = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
    inner = np.ones(len(symbols), dtype=bool)
    inner[ends - 1] = False
    symbols[inner] = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols[~inner] = _STOP
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)
    classes = _CLASS[symbols]
    context = np.zeros(len(symbols), dtype=np.int64)
    for back in (3, 2, 1):
        before = np.full(len(symbols), _START)
        before[back:] = np.where(place[back:] >= back, classes[:-back], _START) if len(symbols) > back else before[back:]
        context = context * 32 + before
    return symbols, context, of


def fit_spelling(cells: np.ndarray, customers: np.ndarray, sweeps: int = 3, discount: float = 0.5, strength: float = 1.0, seed: int = 1) -> Spelling:
    """Seats the customers (of sorted cells of the third level) in the restaurants of all levels, by Gibbs sweeps."""
    levels = []  # third to root: contexts and dishes of the cells, and for each cell its parent's number
    context, dish, width = cells // _DISHES, cells % _DISHES, 32**3
    for _ in range(4):
        width //= 32
        up = (context % max(1, width)) * _DISHES + dish if width else dish
        parents, to = np.unique(up, return_inverse=True)
        levels.append((context, dish, to))
        context, dish = parents // _DISHES, parents % _DISHES
    base = [None] * 4
    tables = [np.ones(len(x[0])) for x in levels]
    for sweep in range(sweeps):
        count = [customers.astype(np.float64)]
        for i in range(3):
            count.append(np.bincount(levels[i][2], tables[i], len(levels[i + 1][0])))
        # top down: each level's predictive probabilities of its cells from its parent's
        above = np.full(len(levels[3][0]), 1.0 / _DISHES)
        for i in (3, 2, 1, 0):
            context, dish, _ = levels[i]
            n = int(context.max()) + 1 if len(context) else 1
            all_c, all_t = np.bincount(context, count[i], n), np.bincount(context, tables[i], n)
            mass = (strength + discount * all_t[context]) * above
            key = cells_key(context, dish, i, sweep, seed)
            n_in = count[i].astype(np.int64)
            # at first as in a new restaurant; customers come and go with the tables of the level below
            tables[i] = reseat(n_in, np.minimum(tables[i], n_in), mass, discount, key) if sweep else seat(n_in, mass, discount, key)
            all_t = np.bincount(context, tables[i], n)
            p = (np.maximum(count[i] - discount * tables[i], 0) + (strength + discount * all_t[context]) * above) / (strength + all_c[context])
            base[i] = p
            if i:
                above = p[levels[i - 1][2]]
    # counts that match the last tables
    count = [customers.astype(np.float64)]
    for i in range(3):
        count.append(np.bincount(levels[i][2], tables[i], len(levels[i + 1][0])))
    above = np.full((1, _DISHES), 1.0 / _DISHES)
    dense = None
    for i, rows in ((3, 1), (2, 32), (1, 1024)):
        context, dish, _ = levels[i]
        all_c, all_t = np.bincount(context, count[i], rows), np.bincount(context, tables[i], rows)
        dense = ((strength + discount * all_t) / (strength + all_c))[:, None] * above[np.arange(rows) % len(above)]
        np.add.at(dense, (context, dish), np.maximum(count[i] - discount * tables[i], 0) / (strength + all_c[context]))
        above = dense
    context = levels[0][0]
    all_c, all_t = np.bincount(context, count[0], 32**3), np.bincount(context, tables[0], 32**3)
    own = np.maximum(count[0] - discount * tables[0], 0) / (strength + all_c[context])
    return Spelling(cells, own, (strength + discount * all_t) / (strength + all_c), dense)


def cells_key(context: np.ndarray, dish: np.ndarray, level: int, sweep: int, seed: int) -> np.ndarray:
    return _mix((context * _DISHES + dish).astype(np.uint64) * np.uint64(64) + np.uint64(seed * 16 + sweep * 4 + level))


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit key of each word (SipHash), the same in every process."""
    return pd.util.hash_array(np.array([*words, None], dtype=object)[:-1], categorize=False).view(np.int64) if words else np.zeros(0, dtype=np.int64)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts with some _TEXTS bytes of texts, so that what is made of them stays in a processor's cache."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TEXTS, "right")))
            yield batch.slice(at, to - at)
            at = to


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a number for each byte
_ODD = 0xD1342543DE82EF95


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD, and those of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n - 1, x, dtype=np.uint64)))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


def lexed(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts (never null), a number by which each is known, the place there of each token of each text and of its end, and how many these are by text.

    The number is a polynomial of the token's bytes modulo 2 ** 64, mixed with its length; 0, the least, is the end's.
    """
    data = b" ".join([*texts(column), b""]).lower()
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = (raw == 0x20) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(1 << max(20, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * powers[: len(raw)], out=sums[1:])
    key = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    # an end of each text stands after its tokens
    of = np.searchsorted(starts, np.cumsum(sizes + 1))
    key = np.insert(key, of, np.uint64(0))
    some, first, ids = blocks.distinct(key)
    # places of the first ones among tokens without ends
    first -= np.searchsorted(of + np.arange(len(of)), first)
    words = [data[a:b] for a, b in zip(*(np.append(x, 0)[first].tolist() for x in (starts, ends)), strict=True)]
    if len(some):
        words[0] = END
    return words, some, ids, np.diff(of, prepend=0) + 1


def _together(parts: list[tuple[list[bytes], np.ndarray]]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of several lists with their numbers by lexed(), and the place there of each of their words."""
    words = [w for part in parts for w in part[0]]
    _, first, to = blocks.distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *[part[1] for part in parts]]))
    return [words[i] for i in first.tolist()], to


def vocabulary(docs: DataFrame) -> DataFrame:
    """_token, _key, _c, _all: each word of the texts, its count in those with _train and in all; the end counts once a text. Texts are never null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            every, to = _together([x[:2] for x in held])
            counts = [np.bincount(to, np.concatenate([x[i] for x in held]), len(every)).astype(np.int64) if held else np.zeros(0, dtype=np.int64) for i in (2, 3)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array(hashed(every)), *map(pa.array, counts)], ["_token", "_key", "_c", "_all"])

        size = 0
        for part in _parts(batches, 1):
            words, key, ids, sizes = lexed(part.column(1))
            train = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
            held.append((words, key, np.bincount(ids, train, len(words)), np.bincount(ids, minlength=len(words))))
            size += len(words)
            if size > _FLUSH:
                yield made()
                size = 0
        yield made()

    made = docs.select("_train", "_text").mapInArrow(count, "_token binary, _key long, _c long, _all long")
    return made.groupBy("_token", "_key").agg(F.sum("_c").alias("_c"), F.sum("_all").alias("_all"))


@dataclass
class _Coded:
    """The most frequent words, numbered. A word's code is its number, or its key if it has none."""

    keys: np.ndarray
    by_key: np.ndarray  # numbers in the order of keys
    ordered: np.ndarray  # keys in their order

    def code(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return keys
        at, found = blocks.places(keys, self.ordered)
        return np.where(found, self.by_key[at], keys)

    def key(self, codes: np.ndarray) -> np.ndarray:
        has = (codes >= 0) & (codes < len(self.keys))
        return np.where(has, self.keys[np.where(has, codes, 0)], codes) if len(self.keys) else codes


def _numbered(words: DataFrame, least: int) -> tuple[Broadcast, int]:
    """Numbers of the words with at least so many occurrences, from the most frequent on, and how many these are."""
    first = words.where(F.col("_all") >= least).select("_key", "_all").toArrow()  # at most ``head`` rows
    keys = np.array(first.column(0), dtype=np.int64)
    keys = keys[np.lexsort((keys, -np.array(first.column(1), dtype=np.int64)))]
    return words.sparkSession.sparkContext.broadcast(_Coded(keys, np.argsort(keys), np.sort(keys))), len(keys)


def _below(code: str, n: int) -> Column:
    """Whether a code is one of the first n numbers."""
    return F.col(code).between(0, n - 1)


def follows(docs: DataFrame, head: Broadcast, contexts: np.ndarray | None = None) -> DataFrame:
    """_ctx, _word, _c, _all: how often a word (its code) comes after another or after the start, in texts with _train and in all.

    ``contexts`` are the keys of the words after which it counts, if not after all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _followers(batches, head, contexts):
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], ["_ctx", "_word", "_c", "_all"])

    # rows are counted together in their tasks, so they are dealt out at once
    rows = docs.select("_train", "_text").mapInArrow(count, "_ctx long, _word long, _c long, _all long").repartition("_ctx", "_word")
    return rows.groupBy("_ctx", "_word").agg(F.sum("_c").alias("_c"), F.sum("_all").alias("_all"))


def _followers(batches: Iterator[pa.RecordBatch], head: Broadcast, contexts: np.ndarray | None) -> Iterator[list[np.ndarray]]:
    """Columns of follows(), counted over some millions of tokens at once."""
    held: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]] = []

    def made() -> list[np.ndarray]:
        words, to = _together([([END], np.zeros(1, dtype=np.uint64)), *[x[:2] for x in held]])
        key = hashed(words)
        code = head.value.code(key)
        codes, at = [], 1
        for part, _, ids, train in held:
            ids = to[at : at + len(part)][ids]
            before = np.concatenate(([0], ids[:-1]))  # each text has an end, and so has the start
            codes.append(before << 32 | ids << 1 | train)
            at += len(part)
        held.clear()
        some, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64), return_counts=True)
        before, after, train = some >> 32, some >> 1 & 0x7FFFFFFF, some & 1
        ctx, word = code[before], code[after]
        keep = slice(None) if contexts is None else np.isin(key[before], contexts)
        return [x[keep] for x in (ctx, word, n * train, n)]

    tokens_, words_ = 0, 0
    for part in _parts(batches, 1):
        words, key, ids, sizes = lexed(part.column(1))
        held.append((words, key, ids, np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)))
        tokens_, words_ = tokens_ + len(ids), words_ + len(words)
        if tokens_ > _TOKENS or words_ > 2 * _FLUSH:
            yield made()
            tokens_, words_ = 0, 0
    yield made()


def _pair_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (_mix(word.view(np.uint64)) + ctx.view(np.uint64)).view(np.int64)


def _dealt_pairs(ctx: np.ndarray, word: np.ndarray, more: list[np.ndarray], numbered: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of pairs of codes: CORE ones have one code, REST ones both."""
    core = (ctx >= 0) & (ctx < numbered) & (word >= 0) & (word < numbered)
    where, rest = blocks.bucket(_pair_key(ctx, word), buckets), ~core
    yield from blocks.dealt(CORE, where[core], [ctx[core] << 32 | word[core], *[x[core] for x in more]])
    yield from blocks.dealt(REST, where[rest], [ctx[rest], word[rest], *[x[rest] for x in more]])


def repeated(docs: DataFrame, head: Broadcast, numbered: int, buckets: int, contexts: np.ndarray | None = None) -> DataFrame:
    """Blocks of the pairs of follows() that come more than once in all texts, with _c and _all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _followers(batches, head, contexts)
        return blocks.batches(row for ctx, word, c, n in some for row in _dealt_pairs(ctx, word, [c.astype(np.int32), n.astype(np.int32)], numbered, buckets))

    def add(where: int, of: dict[int, list[bytes]]) -> Iterator[tuple[int, int, bytes]]:
        for kind, keys in ((CORE, 1), (REST, 2)):
            columns = blocks.gathered(of.pop(kind, []), "q" * keys + "ii")
            columns = blocks.summed([c.astype(np.int64) for c in columns], keys)
            yield where, kind, blocks.packed([c[columns[-1] > 1] for c in columns])

    return blocks.grouped(docs.select("_train", "_text").mapInArrow(count, blocks.SCHEMA), add)


def _rows(made: DataFrame, kind: int, columns: Callable[[bytes], list[np.ndarray]], schema: str) -> DataFrame:
    """Rows of the columns that a function finds in each block of a kind."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(2).to_pylist():
                yield _arrow(columns(block), schema)

    return made.where(F.col("_kind") == kind).mapInArrow(unpack, schema)


def _sums(dense: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of a task's sums by number of a word, of numbers that have any."""
    used = np.flatnonzero(dense.any(0))
    yield from blocks.dealt(SUMS, used // _SLICE, [used, *dense[:, used]])


def _by_code(made: DataFrame, names: list[str]) -> DataFrame:
    """Rows of _code and the sums over all tasks."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(["_code", *names], blocks.summed(blocks.gathered(table.column("_block").to_pylist(), "q" * (len(names) + 1)), 1), strict=True)))

    return made.where(F.col("_kind") == SUMS).groupBy("_bucket").applyInArrow(add, ", ".join(f"{c} long" for c in ["_code", *names]))


def _discount(ones: int | None, twos: int | None) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones or twos else 0.5


def _looked_up(rows: DataFrame, words: DataFrame, hot: int, by: dict[str, list]) -> DataFrame:
    """Columns of words for each of by's codes: of the ``hot`` most frequent from a broadcast, else by joins, whose keys are rare."""
    for code, columns in by.items():
        some = words.select(F.col("_code").alias(code), *columns)
        told = rows.where(_below(code, hot)).join(F.broadcast(some.where(_below(code, hot))), code)
        rows = told.unionByName(rows.where(~_below(code, hot)).join(some.where(~_below(code, hot)), code))
    return rows


@dataclass
class Model:
    table: DataFrame  # _key, _code, _token, _c, _all, _lp (log10 without a context), _whole and _back: customers and strength of its own restaurant, and the weight of the one without a context there
    blocks: DataFrame  # of pairs that come more than once in all texts: codes, _all, _over (customers beyond the tables' discounts)
    buckets: int  # of which there are so many
    strength: float
    discount: float  # of the contexts' restaurants
    n: int  # training tokens
    v: int  # distinct ones
    least: int  # words with so many occurrences, at most ``head`` of them, are the head
    head: Broadcast  # their numbers, of which there are ``numbered``
    numbered: int
    keys: np.ndarray | None  # of the contexts, if not all words are
    contexts: list[bytes] | None
    docs: DataFrame

    @property
    def several(self) -> DataFrame:
        """_ctx, _word (codes), _all, _over: the pairs of the blocks."""
        schema = "_ctx long, _word long, _all long, _over double"
        core = lambda block: [(found := blocks.unpacked(block, _PAIRS[CORE]))[0] >> 32, found[0] & 0xFFFFFFFF, *found[1:]]
        return _rows(self.blocks, CORE, core, schema).unionByName(_rows(self.blocks, REST, lambda block: blocks.unpacked(block, _PAIRS[REST]), schema))

    @property
    def pairs(self) -> DataFrame:
        """_ctx, _word (keys), _own: what a context's restaurant adds for each word that came after it in training."""
        every = follows(self.docs, self.head, self.keys).where("_c > 0").select("_ctx", "_word").join(self.several.select("_ctx", "_word", "_over"), ["_ctx", "_word"], "left")
        ctx = self.table.select(F.col("_code").alias("_ctx"), F.col("_key").alias("_before"), "_whole")
        word = self.table.select(F.col("_code").alias("_word"), F.col("_key").alias("_after"))
        own = F.coalesce("_over", F.lit(1 - self.discount)) / F.col("_whole")
        return every.join(ctx, "_ctx").join(word, "_word").select(F.col("_before").alias("_ctx"), F.col("_after").alias("_word"), own.alias("_own"))

    @property
    def words(self) -> DataFrame:
        """_token, _c, _lp, _ctxs (numbers in contexts) and _owns of them, where contexts are limited."""
        number = self.docs.sparkSession.createDataFrame([(int(k), i) for i, k in enumerate(self.keys)], "_ctx long, _number int")
        of = self.pairs.join(F.broadcast(number), "_ctx").groupBy(F.col("_word").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("_number", "_own"))).alias("_all"))
        made = self.table.select("_key", "_token", "_c", "_lp").join(of, "_key", "left")
        return made.select("_token", "_c", "_lp", F.coalesce("_all._number", F.array().cast("array<int>")).alias("_ctxs"), F.coalesce("_all._own", F.array().cast("array<double>")).alias("_owns"))

    @property
    def back(self) -> np.ndarray:
        """By number of the context, where contexts are limited."""
        found = {r._key: r._back for r in self.table.where(F.col("_key").isin(self.keys.tolist())).select("_key", "_back").collect()}
        return np.array([found.get(k, 1.0) for k in self.keys.tolist()])


def _arrow(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in names.split(", ")])


def fit(docs: DataFrame, sweeps: int = SWEEPS, strength: float = 10.0, contexts: int | None = CONTEXTS, head: int = HEAD) -> Model:
    """A model from rows of _text, _train; its vocabulary also has, with count 0, the words of the other texts."""
    words = materialise(vocabulary(docs), 20_000)
    names, keys = None, None
    if contexts is not None:
        first = words.where((F.col("_c") > 0) & (F.col("_token") != END)).orderBy(F.desc("_c"), "_token").limit(contexts)
        names = [END, *[bytes(r._token) for r in first.select("_token").collect()]]  # at most ``contexts``
        keys = hashed(names)
    least = _least(words, head)
    coded, numbered = _numbered(words, least)
    hot = min(HOT, numbered)
    zero = F.lit(0.0)
    of = lambda c: F.coalesce(c, F.lit(0))

    # pairs that come once in all texts have one customer at one table, or none: they are only counted
    buckets = _buckets(words.agg(F.sum("_all")).first()[0] or 0)
    found = materialise(repeated(docs, coded, numbered, buckets, keys), 500)
    pair_state = "_ctx long, _word long, _c long, _all long, _t int, _ts long"

    def start(block: bytes) -> list[np.ndarray]:
        """Pairs of words of which one has no number, with a table each."""
        ctx, word, c, every = (x for x in blocks.unpacked(block, _COUNTED[REST]))
        keep = c > 1
        return [x[keep] for x in (ctx, word, c, every, np.ones(len(c), dtype=np.int32), np.zeros(len(c), dtype=np.int64))]

    pairs, core = materialise(_rows(found, REST, start, pair_state), 50_000), found.where(F.col("_kind") == CORE)

    def sums(core: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
        """Sums by word and by context: _code, and each column's for both."""
        ways, none = ("_word", "_ctx"), F.lit(0).cast("long")
        names = [f"{c}{k}" for k in ways for c in columns]
        rows = [pairs.select(F.col(k).alias("_code"), *[F.col(c).cast("long").alias(f"{c}{x}") if x == k else none.alias(f"{c}{x}") for x in ways for c in columns]) for k in ways]
        return functools.reduce(DataFrame.unionByName, [_by_code(core, names), *rows]).groupBy("_code").agg(*[F.sum(c).alias(c) for c in names])

    def first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of customers and first tables of numbered pairs, and how many of these come twice."""
        dense, twos = np.zeros((4, numbered), dtype=np.int64), 0
        for batch in batches:
            for block in batch.column(2).to_pylist():
                code, c, _ = blocks.unpacked(block, _COUNTED[CORE])
                code, c = code[c > 1], c[c > 1]
                twos += int(np.count_nonzero(c == 2))
                for i, numbers in enumerate((code & 0xFFFFFFFF, code >> 32)):
                    np.add.at(dense[2 * i], numbers, c)
                    np.add.at(dense[2 * i + 1], numbers, 1)
        yield from blocks.batches(iter([*_sums(dense), (0, TWOS, blocks.packed([np.array([twos])]))]))

    core_sums = materialise(core.mapInArrow(first_sums, blocks.SCHEMA), _BLOCKS)

    # words that come at most once in training have as many tables and pairs, so they stay as they are
    every, few = words, words.where("_c <= 1").select("_key", "_token", "_c", "_all")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _arrow([*batch.columns, coded.value.code(np.array(batch.column(0)))], "_key, _token, _c, _all, _code")

    words = every.where("_c > 1").select("_key", "_token", "_c", "_all").mapInArrow(code, "_key long, _token binary, _c long, _all long, _code long")
    words = materialise(words.join(sums(core_sums, pairs, "_c", "_t"), "_code", "left").select(
        "_key", "_code", "_token", "_c", "_all", (F.col("_c") - of("_c_word")).alias("_direct"), (F.col("_c") - of("_c_ctx")).alias("_alone"), (F.col("_c") - of("_c_word") + of("_t_word")).alias("_n"),
        F.lit(1.0).alias("_t"), (F.col("_c") - of("_c_ctx") + of("_t_ctx")).alias("_seats"), F.lit(0).cast("long").alias("_seated"), zero.alias("_g"), F.lit(float("-inf")).alias("_sum"),
    ), 20_000)
    has = F.lit(True) if keys is None else F.col("_key").isin(keys.tolist())
    ones = few.where("_c = 1").agg(F.count(F.lit(1)).alias("v"), F.count_if(has).alias("p1")).first()
    sizes = words.agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("_n") == 1).alias("n1"), F.count_if(F.col("_n") == 2).alias("n2"), F.sum(F.when(has, F.col("_alone"))).alias("p1")).first()
    n, v = (sizes.c or 0) + ones.v, sizes.v + ones.v
    twos = sum(int(blocks.unpacked(r._block, "q")[0][0]) for r in core_sums.where(F.col("_kind") == TWOS).collect())  # a row a task
    discard(core_sums)
    discount, pair_discount = _discount(sizes.n1 + ones.v, sizes.n2), _discount((sizes.p1 or 0) + ones.p1, pairs.where("_c = 2").count() + twos)

    def totals(words: DataFrame) -> tuple[float, float]:
        """Customers and tables without a context."""
        one = words.agg(F.sum("_n").alias("n"), F.sum("_t").alias("t")).first()
        return float((one.n or 0) + ones.v), float((one.t or 0.0) + ones.v)

    def cells(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Customers of the spelling model's cells: at most 32 ** 3 * 257 rows."""
        made = words.mapInArrow(_spelling_counts, "_cell long, _n double").groupBy("_cell").agg(F.sum("_n").alias("_n")).toArrow()
        return np.array(made.column(0), dtype=np.int64), np.array(made.column(1), dtype=np.float64)

    customers, tables = totals(words)
    state = "_key long, _code long, _token binary, _c long, _all long, _direct long, _alone long, _n long, _t double, _seats long, _seated long, _g double, _sum double"
    constant, drawn_by = cells(few.where("_c = 1").select("_token", F.lit(1.0).alias("_t"))), []
    for sweep in range(sweeps):
        cell, customers_of = map(np.concatenate, zip(constant, cells(words.select("_token", "_t")), strict=True))
        cell, to = np.unique(cell, return_inverse=True)
        spelling = docs.sparkSession.sparkContext.broadcast(fit_spelling(cell, np.bincount(to, customers_of, len(cell)), seed=sweep))
        mass, whole = strength + discount * tables, strength + customers

        def spell(batches: Iterator[pa.RecordBatch], spelling=spelling) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _arrow([*batch.columns[:11], spelling.value.log_words(list(texts(batch.column(2)))), batch.column(12)], state)

        # the restaurants of contexts, given what their parent predicts
        words, old = materialise(words.mapInArrow(spell, state), 20_000), words
        discard(old)
        p = (F.greatest(F.col("_n") - discount * F.col("_t"), zero) + mass * F.exp("_g")) / whole
        by = {"_ctx": [(strength + pair_discount * F.col("_seats")).alias("_mass")], "_word": [p.alias("_p")]}
        first = words.where(F.col("_all") >= least).select("_code", *by["_ctx"], *by["_word"]).toArrow()  # at most ``head`` rows
        of_head = np.zeros((2, numbered))
        of_head[:, np.array(first.column(0), dtype=np.int64)] = np.array(first.column(1)), np.array(first.column(2))
        sent = docs.sparkSession.sparkContext.broadcast(of_head)
        del first, of_head

        def drawn_tables(ctx, word, c, t, m, p, sweep=sweep) -> np.ndarray:
            key = _mix(_mix(coded.value.key(word).view(np.uint64) + np.uint64(1000 * (sweep + 1))) + coded.value.key(ctx).view(np.uint64))
            return (reseat(c, t.astype(np.float64), m * p, pair_discount, key) if sweep else seat(c, m * p, pair_discount, key)).astype(np.int32)

        def draw(batches: Iterator[pa.RecordBatch], tables=drawn_tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ctx, word, c, t, ts, m, p = (np.array(batch.column(i)) for i in (0, 1, 2, 4, 5, 6, 7))
                t = tables(ctx, word, c, t, m, p)
                yield _arrow([*batch.columns[:4], t, ts + t], pair_state)

        def draw_core(batches: Iterator[pa.RecordBatch], sweep=sweep, sent=sent, tables=drawn_tables) -> Iterator[pa.RecordBatch]:
            dense = np.zeros((2, numbered), dtype=np.int64)

            def drawn_blocks() -> Iterator[tuple[int, int, bytes]]:
                for batch in batches:
                    for where, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                        if sweep:
                            code, c, every, ts, t = blocks.unpacked(block, _STATE)
                        else:
                            code, c, every = (x[blocks.unpacked(block, _COUNTED[CORE])[1] > 1] for x in blocks.unpacked(block, _COUNTED[CORE]))
                            ts, t = np.zeros(len(c), dtype=np.int64), np.ones(len(c), dtype=np.int32)
                        ctx, word = code >> 32, code & 0xFFFFFFFF
                        t = tables(ctx, word, c, t, sent.value[0][ctx], sent.value[1][word])
                        np.add.at(dense[0], word, t)
                        np.add.at(dense[1], ctx, t)
                        yield where, STATE, blocks.packed([code, c, every, ts + t, t])
                yield from _sums(dense)

            yield from blocks.batches(drawn_blocks())

        names_ = [c.split()[0] for c in pair_state.split(", ")]
        made = core.mapInArrow(draw_core, blocks.SCHEMA), _looked_up(pairs, words, hot, by).select(*names_, "_mass", "_p").mapInArrow(draw, pair_state)
        made = materialise(made[0], _BLOCKS), materialise(made[1], 50_000)
        discard(*[old for old in (core, pairs) if sweep or old is pairs])
        (core_sums, pairs), core = made, made[0].where(F.col("_kind") == STATE)

        # their parent, whose customers are their tables
        def seats(batches: Iterator[pa.RecordBatch], sweep=sweep, mass=mass) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, n, t, g = (np.array(batch.column(i)) for i in (0, 7, 8, 11))
                key = _mix(key.view(np.uint64) + np.uint64(1000 * (sweep + 1) + 999))
                t = reseat(n, np.minimum(t, n), mass * np.exp(g), discount, key) if sweep else seat(n, mass * np.exp(g), discount, key)
                yield _arrow([*batch.columns[:8], t, *batch.columns[9:]], state)

        made = words.join(sums(core_sums, pairs, "_t"), "_code", "left")
        taken = F.col("_alone") + of("_t_ctx")
        made = made.select("_key", "_code", "_token", "_c", "_all", "_direct", "_alone", (F.col("_direct") + of("_t_word")).alias("_n"), "_t", taken.alias("_seats"), (F.col("_seated") + taken).alias("_seated"), "_g", "_sum")
        drawn, old = materialise(made.mapInArrow(seats, state), 20_000), words
        discard(old)
        customers, tables = totals(drawn)
        # _g and _sum are logarithms: the spelling of a long word has a probability below any double
        own, mass = F.greatest(F.col("_n") - discount * F.col("_t"), zero), strength + discount * tables
        p = F.when(own > 0, F.log(own + mass * F.exp("_g"))).otherwise(F.lit(math.log(mass)) + F.col("_g")) - math.log(strength + customers)
        more, less = F.greatest("_sum", p), F.least("_sum", p)
        words = drawn.withColumn("_sum", more + F.log1p(F.exp(less - more)))
        drawn_by.append((spelling, mass, strength + customers))
    each = max(1, sweeps)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """_sum of words that come at most once, over all sweeps."""
        for batch in batches:
            some, c = list(texts(batch.column(1))), np.array(batch.column(2))
            own, total = np.where(c > 0, 1 - discount, 0.0), np.full(batch.num_rows, -np.inf)
            letters = spelled(some)
            for spelling, mass, whole in drawn_by:
                g = spelling.value.log_words(some, letters)
                with np.errstate(divide="ignore"):
                    total = np.logaddexp(total, np.where(own > 0, np.log(own + mass * np.exp(g)), math.log(mass) + g) - math.log(whole))
            yield _arrow([*batch.columns, coded.value.code(np.array(batch.column(0))), c * sweeps, total], few_state)

    few_state = "_key long, _token binary, _c long, _all long, _code long, _seated long, _sum double"
    both = words.select(*[c.split()[0] for c in few_state.split(", ")]).unionByName(few.mapInArrow(summed, few_state))
    back = (strength + F.col("_seated") * (pair_discount / each)) / (strength + F.col("_c"))
    table = materialise(both.select("_key", "_code", "_token", "_c", "_all", ((F.col("_sum") - math.log(each)) / math.log(10)).alias("_lp"), (strength + F.col("_c")).alias("_whole"), back.alias("_back")), 20_000)
    discard(words, every)
    share = pair_discount / each

    def over_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for where, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    code, c, every, ts, _ = blocks.unpacked(block, _STATE)
                    yield where, CORE, blocks.packed([code, every, c - ts * share])

        return blocks.batches(rows())

    def over_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that come at most once in training have as many tables."""

        def rows() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for where, kind, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    *codes, c, every = blocks.unpacked(block, _COUNTED[kind])
                    keep = c <= (1 if sweeps or kind == REST else np.inf)
                    yield where, kind, blocks.packed([x[keep] for x in (*codes, every, np.where(c <= 1, c * (1 - pair_discount), c))])

        return blocks.batches(rows())

    def over_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                ctx, word, c, every, _, ts = (np.array(x) for x in batch.columns)
                yield from _dealt_pairs(ctx, word, [every, c - ts * share], numbered, buckets)

        return blocks.batches(rows())

    several = found.mapInArrow(over_few, blocks.SCHEMA)
    several = several.unionByName(core.mapInArrow(over_core, blocks.SCHEMA)) if sweeps else several
    made = materialise(several, _BLOCKS).unionByName(materialise(pairs.mapInArrow(over_rest, blocks.SCHEMA), 50_000))
    discard(found, pairs, *[core] * (sweeps > 0))
    return Model(table, made, buckets, strength, pair_discount, n, v, least, coded, numbered, keys, names, docs)


def _buckets(tokens: int) -> int:
    made = max(8, tokens // _BUCKET)
    return made if made <= 1000 else math.isqrt(1000 * made)


def _spelling_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = (np.zeros(0, dtype=np.int64), np.zeros(0))
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            batch = whole.slice(at, 20_000)
            symbols, context, of = spelled(list(texts(batch.column(0))))
            cells = np.concatenate((sums[0], context * _DISHES + symbols))
            weight = np.concatenate((sums[1], np.array(batch.column(1))[of]))
            cells, to = np.unique(cells, return_inverse=True)
            sums = cells, np.bincount(to, weight, len(cells))
    yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1])], ["_cell", "_n"])


def _least(rows: DataFrame, most: int) -> int:
    """A number of occurrences that at most ``most`` rows have or exceed."""
    return _least_of(rows.groupBy(F.floor(F.log2("_all") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_all").alias("least")), most)


def _least_of(bins: DataFrame, most: int) -> int:
    """The same from rows by the number's logarithm: bin, n, least."""
    least, total = 1 << 62, 0
    for b in sorted(bins.collect(), reverse=True):  # some hundreds
        if (total := total + b.n) > most:
            break
        least = b.least
    return least


def _frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and customers of the most frequent pairs of numbered words, at most so many."""

    def bins(block: bytes) -> list[np.ndarray]:
        every = blocks.unpacked(block, _PAIRS[CORE])[1]
        some, to, n = np.unique(np.floor(np.log2(every) * 16).astype(np.int64), return_inverse=True, return_counts=True)
        least = np.full(len(some), 1 << 62)
        np.minimum.at(least, to, every)
        return [some, n, least]

    made = _rows(pairs, CORE, bins, "bin long, n long, least long").groupBy("bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    least = _least_of(made, most)

    def first(block: bytes) -> list[np.ndarray]:
        code, every, over = blocks.unpacked(block, _PAIRS[CORE])
        return [code[every >= least], over[every >= least]]

    found = _rows(pairs, CORE, first, "_code long, _over double").toArrow()  # at most ``most`` rows
    code = np.array(found.column(0), dtype=np.int64)
    order = np.argsort(code)
    return code[order], np.array(found.column(1), dtype=np.float64)[order]


@dataclass
class _Head:
    """What scoring knows of the most frequent words, by number, and log10 of the probability of the most frequent pairs, by number of the context * 2 ** 32 + number."""

    base: np.ndarray
    known: np.ndarray  # whether training texts have it
    log_p: np.ndarray  # log10
    back: np.ndarray
    whole: np.ndarray
    codes: np.ndarray
    pair_log_p: np.ndarray

    def after(self, before: np.ndarray, ids: np.ndarray, over: np.ndarray) -> np.ndarray:
        """log10 of the probability of words after others, of whose restaurants ``over`` customers are the words'."""
        own, share = over / self.whole[before], self.back[before]
        with np.errstate(divide="ignore"):
            return np.where(own > 0, np.log10(own + share * 10.0 ** self.log_p[ids]), np.log10(share) + self.log_p[ids])

    def score(self, ids: np.ndarray, before: np.ndarray, free: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each word's probability after the one with number ``before``, or where ``free`` without a context, and whether the head tells it.

        Where the head has both words but not the pair, it is that of a pair with ``once`` customers; null for other words.
        """
        told = (ids >= 0) & free
        p = np.where(told, self.log_p[ids], np.nan)
        at = np.flatnonzero((ids >= 0) & (before >= 0) & ~free)
        p[at] = self.after(before[at], ids[at], once[at])
        if len(self.codes) and len(at):
            place, found = blocks.places(before[at] << 32 | ids[at], self.codes)
            told[at[found]] = True
            p[at[found]] = self.pair_log_p[place[found]]
        return p, told


def score(docs: DataFrame, train, sweeps: int = SWEEPS, head: int = HEAD, paired: int = PAIRED, contexts: int | None = CONTEXTS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row for each row of docs (doc_id, text).

    ``train`` is a boolean Column of docs: who teaches the model; null is no. Tokens are the words between white
    space, A-Z lower-cased, and one end. A null text is empty: its end alone is scored. base_score is that of counts
    with 0.1 added; both scores are sums of log10. Repeated rows are documents like others. A null doc_id stays
    null. Without training texts counts are 0 and the spelling model is uniform. A perplexity beyond a double's range
    is infinity. All words and the start are contexts, or if ``contexts`` is a number that many most frequent ones and
    the start; words of equal counts in the order of their bytes. Of docs only doc_id, text and what
    ``train`` names are read, so further columns do no harm.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    model = fit(rows.select("_text", "_train"), sweeps, contexts=contexts, head=head)
    coded, numbered, keys, once, strength, buckets = model.head, model.numbered, model.keys, 1 - model.discount, model.strength, model.buckets
    n = model.n + 0.1 * (model.v + 1)
    first = model.table.where(F.col("_all") >= model.least).select("_code", "_c", "_lp", "_back").toArrow()  # at most ``head`` rows
    order = np.argsort(np.array(first.column(0), dtype=np.int64))
    c, lp, back = (np.append(np.array(first.column(i), dtype=np.float64)[order], 0.0) for i in (1, 2, 3))
    none = np.zeros(0, dtype=np.int64)
    table = _Head(np.log10((c + 0.1) / n), (c > 0).astype(np.float64), lp, back, c + strength, none, none.astype(np.float64))
    del first, order
    codes, over = _frequent(model.blocks, paired)
    table.codes, table.pair_log_p = codes, table.after(codes >> 32, codes & 0xFFFFFFFF, over)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    del codes, over, table

    def seldom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words without a number."""
        return blocks.batches(row for b in batches for columns in [[np.array(x) for x in b.columns]] for row in blocks.dealt(WORDS, blocks.bucket(columns[0], buckets), columns))

    words = model.table.where(~_below("_code", numbered)).select("_code", "_lp", "_back", F.col("_c").cast("double").alias("_c"))
    words = materialise(words.mapInArrow(seldom, blocks.SCHEMA), 500_000)
    rows = rows.select(F.xxhash64("_doc", "_text").alias("_row"), "_doc", "_text", "_train")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with what the head tells of them, and what they ask."""
        table, head = sent.value, coded.value
        end = hashed([END])
        start = int(head.code(end)[0])

        def of(batch: pa.RecordBatch) -> dict[int, list[np.ndarray]]:
            words, _, ids, sizes = lexed(batch.column(2))
            code = head.code(hashed(words))[ids]
            ids = np.where((code >= 0) & (code < numbered), code, -1)
            rare = np.flatnonzero(ids < 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            before, ctx = np.roll(ids, 1), np.roll(code, 1)
            before[starts] = start if 0 <= start < numbered else -1
            ctx[starts] = start  # the start of a text
            free = np.zeros(len(ids), dtype=bool) if keys is None else ~np.isin(coded.value.key(ctx), keys)
            row, train = np.array(batch.column(0)), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            p, told = table.score(ids, before, free, np.zeros(len(ids)))
            known = ids >= 0
            sums = [np.bincount(doc, x, len(sizes)) for x in (np.where(told, p, 0.0), np.where(known, table.base[ids], 0.0), np.where(known, table.known[ids], 0.0), np.ones(len(ids)))]
            id_ = batch.column(1)
            texts_ = [row, np.array(id_.fill_null(0)), np.ones(len(row), dtype=np.int64), np.array(id_.is_null()).astype(np.int8), *sums]
            flag = (np.where(train, _TRAINS, 0)[doc] | np.where(free, _FREE, 0)).astype(np.int8)
            near = np.flatnonzero(~told & known & (before >= 0))
            asked = {TEXT: texts_, NEAR: [before[near] << 32 | ids[near] | np.where(train[doc[near]], _NEAR_TRAINS, 0), row[doc[near]]]}
            for kind, at in ((WORD, rare), (CONTEXT, np.flatnonzero(~told & known & (before < 0)))):
                asked[kind] = [ctx[at], code[at], row[doc[at]], *([np.full(len(at), np.nan)] if kind == CONTEXT else []), flag[at]]
            return asked

        def dealt(held: list[dict[int, list[np.ndarray]]]) -> Iterator[tuple[int, int, bytes]]:
            for kind in (TEXT, NEAR, WORD, CONTEXT):
                columns = [np.concatenate(x) for x in zip(*(h[kind] for h in held), strict=True)]
                if kind == NEAR:
                    where = _pair_key(columns[0] >> 32 & 0x3FFFFFFF, columns[0] & 0xFFFFFFFF)
                else:
                    where = columns[0] if kind in (TEXT, CONTEXT) else columns[1]
                yield from blocks.dealt(kind, blocks.bucket(where, buckets), columns)

        def made() -> Iterator[tuple[int, int, bytes]]:
            held, size = [], 0
            for batch in _parts(batches, 2):
                held.append(of(batch))
                size += sum(len(x[0]) for x in held[-1].values())
                if size > _ASKS:
                    yield from dealt(held)
                    held, size = [], 0
            if held:
                yield from dealt(held)

        return blocks.batches(made())

    Made = Iterator[tuple[int, int, bytes]]

    def looked_up(of: dict[int, list[bytes]], kind: int, by: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What asks for words without a number, by the column that has their codes, and what these have: _lp, _back, _c."""
        asked = blocks.gathered(of.pop(kind, []), _ASKED[kind])
        code, *has = blocks.gathered(of.pop(WORDS, []), _ASKED[WORDS])
        order = np.argsort(code)
        at, found = blocks.places(asked[by], code[order])
        if not found.all():
            raise ValueError("a text has a word that the vocabulary lacks")
        return asked, [x[order[at]] if len(at) else x[:0] for x in has]

    def passed(where: int, of: dict[int, list[bytes]]) -> Made:
        return ((where, kind, block) for kind, some in of.items() for block in some)

    def tell_words(where: int, of: dict[int, list[bytes]]) -> Made:
        (ctx, word, row, flag), (lp, _, c) = looked_up(of, WORD, 1)
        yield from blocks.dealt(OF_WORD, blocks.bucket(row, buckets), [row, np.log10((c + 0.1) / n), (c > 0).astype(np.float64)])
        free = (flag & _FREE) > 0
        yield from blocks.dealt(OF_PAIR, blocks.bucket(row[free], buckets), [row[free], lp[free]])
        has = (ctx >= 0) & (ctx < numbered)
        at = ~has & ~free
        yield from blocks.dealt(CONTEXT, blocks.bucket(ctx[at], buckets), [x[at] for x in (ctx, word, row, lp, flag)])
        at, nan = has & ~free, np.full(len(ctx), np.nan)
        yield from blocks.dealt(PAIR, blocks.bucket(_pair_key(ctx, word), buckets)[at], [x[at] for x in (ctx, word, row, lp, nan, nan, flag)])
        yield from passed(where, of)

    def tell_contexts(where: int, of: dict[int, list[bytes]]) -> Made:
        (ctx, word, row, lp, flag), (_, back, c) = looked_up(of, CONTEXT, 0)
        yield from blocks.dealt(PAIR, blocks.bucket(_pair_key(ctx, word), buckets), [ctx, word, row, lp, back, c + strength, flag])
        yield from passed(where, of)

    def tell_pairs(where: int, of: dict[int, list[bytes]]) -> Made:
        """A pair that comes once in all texts has a customer if its text is a training text."""
        table = sent.value
        code, _, over = blocks.gathered(of.pop(CORE, []), _PAIRS[CORE])
        order = np.argsort(code)
        asked, row = blocks.gathered(of.pop(NEAR, []), _ASKED[NEAR])
        train, asked = asked >= _NEAR_TRAINS, asked & (_NEAR_TRAINS - 1)
        at, found = blocks.places(asked, code[order])
        own = np.where(train, once, 0.0)
        own[found] = over[order[at[found]]]
        p = table.after(asked >> 32, asked & 0xFFFFFFFF, own)
        ctxs, words, _, over = blocks.gathered(of.pop(REST, []), _PAIRS[REST])
        key = _pair_key(ctxs, words)
        order = np.argsort(key)
        ctx, word, rows, lp, back, whole, flag = blocks.gathered(of.pop(PAIR, []), _ASKED[PAIR])
        at, found = blocks.places(_pair_key(ctx, word), key[order])
        own = np.where(flag & _TRAINS, once, 0.0)
        own[found] = over[order[at[found]]]
        id_, to = np.where((word >= 0) & (word < numbered), word, -1), np.where((ctx >= 0) & (ctx < numbered), ctx, -1)
        lp, back, whole = np.where(id_ >= 0, table.log_p[id_], lp), np.where(to >= 0, table.back[to], back), np.where(to >= 0, table.whole[to], whole)
        # without an own part the product stays a sum of logarithms: a long word's probability is below any double
        with np.errstate(divide="ignore"):
            lp = np.where(own > 0, np.log10(own / whole + back * 10.0**lp), np.log10(back) + lp)
        row, p = blocks.summed([np.concatenate((row, rows)), np.concatenate((p, lp))], 1)
        yield from blocks.dealt(OF_PAIR, blocks.bucket(row, buckets), [row, p])
        yield from passed(where, of)

    def total(made: pa.Table) -> pa.Table:
        of = blocks.by_kind(made)
        row, doc, times, null, *sums = blocks.gathered(of.get(TEXT, []), _ASKED[TEXT])
        row, doc, null, times, *sums = blocks.summed([row, doc, null, times, *sums], 3)
        for kind, to in ((OF_PAIR, [0]), (OF_WORD, [1, 2])):
            key, *more = blocks.gathered(of.get(kind, []), _ASKED[kind])
            at, _ = blocks.places(key, row)
            for i, x in zip(to, more, strict=True):
                sums[i] = sums[i] + np.bincount(at, x, len(row))
        # rows alike in id and text came together: one for each again
        p, base, known, size = (np.repeat(x / times, times) for x in sums)
        with np.errstate(over="ignore"):
            perplexity = 10.0 ** (-p / size)
        columns = [pa.array(np.repeat(doc, times), mask=np.repeat(null, times) > 0), np.rint(size).astype(np.int64), np.rint(known).astype(np.int64), base, p, perplexity]
        return pa.Table.from_batches([_arrow(columns, scores)])

    scores, some = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double", []
    for part in range(PARTS):
        asked = materialise(rows.where(F.pmod("_row", F.lit(PARTS)) == part).mapInArrow(ask, blocks.SCHEMA), 2000)
        kind = F.col("_kind")
        told = blocks.grouped(asked.where(kind == WORD).unionByName(words), tell_words)
        told = blocks.grouped(told.unionByName(asked.where(kind == CONTEXT)).unionByName(words), tell_contexts)
        told = blocks.grouped(told.unionByName(asked.where(kind.isin(TEXT, NEAR))).unionByName(model.blocks), tell_pairs)
        some.append(materialise(told.groupBy("_bucket").applyInArrow(total, scores)))
        discard(asked)
    discard(model.blocks, words)
    return functools.reduce(DataFrame.unionByName, some).select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
