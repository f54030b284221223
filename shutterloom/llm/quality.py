"""Quality classifier: document evidence on top of hierarchical empirical Bayes rates of hosts and paths.

Features of the text, in bins, give a naive Bayes log-likelihood ratio learned from labelled documents. One of them is
of its words: hashed words' own ratios come from one half of the labels, and how much their mean tells from the other
half, so that no document vouches for the words it brought. Every
document's chance by that alone, or its label where there is one, adds up by path, host and overall. Path rates are
shrunk towards their host's, and host rates towards the global rate, by as many documents as the spread between
groups supports (method of moments), so a site with few documents says little. A document's score is its evidence
on the odds of its path. All in DataFrame operations and grouped aggregations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, materialise

BINS = 8
#: Buckets of hashed words, the most labelled documents that teach them, and bins for each unit of their mean ratio.
WORD_BUCKETS, WORD_DOCS, WORD_SCALE = 4096, 20_000, 4.0
#: The strength of a prior, in documents, is kept between these.
WEAKEST, STRONGEST = 2.0, 2000.0


def features() -> dict[str, Column]:
    """Name and bin (0 to BINS - 1) of each feature of ``_text``, which is never null."""
    text = F.col("_text")
    chars = F.greatest(F.length(text), F.lit(1))
    without = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    bins = lambda share, scale: F.least(F.lit(BINS - 1), F.floor(share * scale)).cast("int")
    parts = F.split(text, "\n", -1)
    return {
        "length": F.least(F.lit(BINS - 1), F.floor(F.log2(chars.cast("double")) / 2)).cast("int"),
        "word_length": bins(chars / (spaces + lines + 1), 0.8),
        "signs": bins(without("|#$%&*!<>{}[]~^=@\\") / chars, 60),
        "digits": bins(F.regexp_count(text, F.lit("[0-9]")) / chars, 40),
        "capitals": bins(F.regexp_count(text, F.lit(r"\p{Lu}")) / chars, 30),
        "stops": bins(F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) / (spaces + lines + 1), 30),
        "line_repeats": bins(1 - F.size(F.array_distinct(parts)) / F.size(parts), 8),
    }


def _buckets() -> Column:
    """The buckets of the distinct words of ``_text``."""
    words = F.array_distinct(F.split(ascii_lower(F.col("_text")), NOT_WORD + "+", -1))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("int")))


def _teaches_words(doc_id: Column) -> Column:
    """Whether a label teaches what words tell; if not, how much that is worth."""
    return F.pmod(F.xxhash64(F.lit("words"), doc_id), F.lit(2)) == 1


def _word_ratios(rows: DataFrame, known: DataFrame) -> list[float]:
    """Each bucket's log-likelihood ratio, with add-one smoothing, from at most WORD_DOCS labelled documents, those of the smallest hashes."""
    some = known.where(_teaches_words(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(WORD_DOCS)
    taught = rows.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("_label", F.explode(_buckets()).alias("b"))
    got = {r.b: (r.good, r.bad) for r in taught.groupBy("b").agg(F.sum("_label").alias("good"), F.sum(1 - F.col("_label")).alias("bad")).collect()}  # a row for each bucket
    good, bad = (sum(x[i] for x in got.values()) + WORD_BUCKETS for i in (0, 1))
    return [math.log((got[b][0] + 1) / good) - math.log((got[b][1] + 1) / bad) if b in got else 0.0 for b in range(WORD_BUCKETS)]


def _word_bin(ratios: list[float]) -> Column:
    """The bin of the mean ratio of a text's words."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    mean = F.get(F.transform(F.array(_buckets()), lambda bs: F.aggregate(bs, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size(bs), F.lit(1))), F.lit(0))
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(mean * WORD_SCALE) + BINS // 2)).cast("int")


def _evidence(bins: DataFrame) -> tuple[dict[str, list[float]], float]:
    """For each feature, each bin's log-likelihood ratio, with add-one smoothing, and the share of good ones (0.5 without labels); what reaches the driver has a fixed size."""
    names = [*features(), "words"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{n}").alias("bin")) for n in names]))
    labelled = bins.where("_label is not null").select("_label", "doc_id", pairs.alias("x"))
    labelled = labelled.where((F.col("x.name") != "words") | ~_teaches_words(F.col("doc_id")))
    got = {(r.name, r.bin): (r.good, r.bad) for r in labelled.groupBy("x.name", "x.bin").agg(F.sum("_label").alias("good"), F.sum(1 - F.col("_label")).alias("bad")).collect()}
    made = {}
    for n in names:
        good, bad = ([got.get((n, b), (0.0, 0.0))[i] + 1.0 for b in range(BINS)] for i in (0, 1))
        made[n] = [float(math.log(g / sum(good)) - math.log(b / sum(bad))) for g, b in zip(good, bad, strict=True)]
    good, bad = (sum(x[i] for (n, _), x in got.items() if n == names[0]) for i in (0, 1))
    return made, good / (good + bad) if good + bad else 0.5


def _strength(n: float, noise: float, squares: float, groups: int) -> float:
    """How many documents a prior is worth: what one document varies by, over the variance between groups less what sampling gives.

    Over all groups, n is the documents, noise the sum of documents * rate * (1 - rate) at the prior's rates, squares
    that of documents * (own rate - prior's rate) squared.
    """
    if not n:
        return STRONGEST
    spread = squares / n - noise / n * groups / n
    return min(STRONGEST, max(WEAKEST, noise / n / max(spread, 1e-9)))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, teaches: Column | None = None) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score, keep: one row for each row of docs.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls teach nothing; several for a document are
    averaged). ``teaches`` is a boolean Column of labels: whose quality is looked at, by default all; null is no. By default the host is source and the path lang. Nulls in them form a group of their own. A null text
    counts as empty, and very long texts are measured whole. Repeated rows have a row each and count each. Without
    labels the evidence is 0 and every rate and score 0.5; without rows there are none. Further columns are not read.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col("doc_id"), host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    known = labels.where("quality in (0, 1) and doc_id is not null").where(F.lit(True) if teaches is None else F.coalesce(teaches, F.lit(False)))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.avg(F.col("quality").cast("double")).alias("_label"))
    words = _word_bin(_word_ratios(rows, known))
    rows = rows.select("doc_id", "_host", "_path", *[c.alias(f"_{n}") for n, c in features().items()], words.alias("_words"))
    rows = materialise(rows.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    table, base = _evidence(rows)
    evidence = sum((F.element_at(F.array(*map(F.lit, table[n])), F.col(f"_{n}") + 1) for n in table), F.lit(0.0))
    rows = rows.select("doc_id", "_host", "_path", "_label", evidence.alias("_evidence"))

    base = min(max(base, 0.01), 0.99)
    chance = 1 / (1 + F.exp(-(F.col("_evidence") + F.lit(float(math.log(base / (1 - base)))))))
    paths = materialise(rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("_label", chance)).alias("_s")))
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    # the sum of squares around a mean from plain sums: documents * rate ** 2 is sum ** 2 / documents
    over = hosts.agg(F.sum("_hn").alias("n"), F.sum("_hs").alias("s"), F.sum(F.col("_hs") * F.col("_hs") / F.col("_hn")).alias("q"), F.count(F.lit(1)).alias("groups")).first()
    mean = min(max(over.s / over.n if over.n else base, 0.01), 0.99)
    host_k = _strength(over.n or 0, (over.n or 0) * mean * (1 - mean), (over.q or 0) - 2 * mean * (over.s or 0) + mean * mean * (over.n or 0), over.groups)
    hosts = hosts.select("_h", ((F.col("_hs") + mean * host_k) / (F.col("_hn") + host_k)).alias("_host_rate"))
    paths = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    # between the paths of a host, around its rate
    r = F.col("_host_rate")
    over = paths.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * r * (1 - r)).alias("noise"), F.sum(F.col("_n") * F.pow(F.col("_s") / F.col("_n") - r, 2)).alias("q"), F.count(F.lit(1)).alias("groups")).first()
    path_k = _strength(over.n or 0, over.noise or 0, over.q or 0, over.groups)
    rate = (F.col("_s") + r * path_k) / (F.col("_n") + path_k)
    paths = paths.select(F.col("_host").alias("_ph"), F.col("_path").alias("_pp"), "_host_rate", F.least(F.lit(0.999), F.greatest(F.lit(0.001), rate)).alias("_path_rate"))
    made = rows.join(paths, F.col("_host").eqNullSafe(F.col("_ph")) & F.col("_path").eqNullSafe(F.col("_pp")))
    score = 1 / (1 + F.exp(-(F.col("_evidence") + F.log(F.col("_path_rate") / (1 - F.col("_path_rate"))))))
    made = made.withColumn("_score", score)
    return made.select(
        "doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_evidence").alias("evidence"),
        F.col("_host_rate").alias("host_rate"), F.col("_path_rate").alias("path_rate"), F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("keep"),
    )
