"""Secret scan: fixed shapes, and character Markov models of random strings and ordinary identifiers.

All in DataFrame functions. Two first-order Markov models over characters are counted from labelled samples. The
log-likelihood ratio of a candidate string, per character, says whether it looks more like a random string than like
an identifier. The table of ratios has a fixed size, so it goes into the plan as a constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, unpacked

#: The shapes' patterns, and the least length of what counts (of group 2 for assign).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more of AKIA[A-Z0-9]+: a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"  # runs of 24 or more
ASSIGN_LEAST = 6
#: What the Markov models judge: unbroken strings of this many characters or more.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: The characters of candidates, and one more index (0) for all others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1


def _places(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, rank, end, kind, value>> of the pattern's leftmost non-overlapping matches, in code points.

    What split() leaves between matches and what regexp_extract_all() gives interleave, so their lengths add up to positions.
    """
    kept = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("match"), values.alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        ok = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(ok, F.concat(state["all"], F.array(one))).otherwise(state["all"]).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("all"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["all"]).otherwise(F.array().cast(kept))


def generated_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """text, label: random strings in the alphabets that keys are written in, label 1."""
    h = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.translate(F.base64(F.unhex(h)), "+/=", "")
    forms = (F.substring(h, 1, 40), F.substring(mixed, 1, 32), F.substring(F.upper(mixed), 1, 24), F.base64(F.unhex(h)))
    return spark.range(0, rows, 1, 1).select(F.element_at(F.array(*forms), (F.col("id") % 4 + 1).cast("int")).alias("text"), F.lit(1).alias("label"))


def identifier_samples(docs: DataFrame, max_docs: int = 500) -> DataFrame:
    """text, label: ordinary words, single, joined by _ or -, or run together, label 0.

    They come from the at most max_docs documents whose doc_id has the smallest hash: a bound on what trains the
    models, not on what is scanned. Rows of one doc_id count as one, that with the smallest text.
    """
    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).distinct()
    # at most max_docs ids meet in a task, and none of the texts
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).where("text is not null")
    runs = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?: [A-Za-z]{2,}){0,2}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    some = some.select(F.explode(runs).alias("w"))
    glue = F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), (F.pmod(F.xxhash64("w"), F.lit(4)) + 1).cast("int"))
    return some.select(F.replace("w", F.lit(" "), glue).alias("text"), F.lit(0).alias("label"))


def _index(character: Column) -> Column:
    """1 on for the candidates' characters, 0 for any other."""
    return F.instr(F.lit(ALPHABET), character)


def ratios(samples: DataFrame, smoothing: float = 0.5, backing: float = 5.0) -> list[float]:
    """SIDE * SIDE log-likelihood ratios, at the first character's index * SIDE + the second's.

    Pairs fall back on the second character's own share, which add-smoothing keeps over 0. Without samples every
    ratio is 0. The counts come from a grouping over
    the samples; what reaches the driver is this table, whose size is fixed.
    """
    neighbours = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, 2))
    pairs = samples.where("label in (0, 1) and length(text) > 1").select("label", F.explode(neighbours).alias("pair"))
    pairs = pairs.select("label", _index(F.substring("pair", 1, 1)).alias("a"), _index(F.substring("pair", 2, 1)).alias("b"))
    counts = {(r.label, r.a, r.b): r.n for r in pairs.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {(label, a): sum(counts.get((label, a, b), 0) for b in range(SIDE)) for label in (0, 1) for a in range(SIDE)}
    singles = {(label, b): sum(counts.get((label, a, b), 0) for a in range(SIDE)) + smoothing for label in (0, 1) for b in range(SIDE)}
    share = {(label, b): n / sum(singles[label, c] for c in range(SIDE)) for (label, b), n in singles.items()}
    log_p = lambda label, a, b: math.log((counts.get((label, a, b), 0) + backing * share[label, b]) / (rows[label, a] + backing))
    return [round(log_p(1, a, b) - log_p(0, a, b), 5) for a in range(SIDE) for b in range(SIDE)]


def _ratio(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio for a pair of neighbouring characters."""
    at = lambda i: _index(F.substring(value, i, 1))
    pairs = F.sequence(F.lit(1), F.length(value) - 1)
    return F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.get(table, at(i) * SIDE + at(i + 1))) / (F.length(value) - 1)


def scan(docs: DataFrame, samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with ``found``: array<struct<start, rank, end, kind, value>>, sorted by start, then kind.

    The shapes' matches all stay. A candidate that overlaps none of them is added, as kind markov, if its mean ratio
    is over the threshold, in nats for each pair of characters: at 0.5 a candidate of 20 characters is some 13,000
    times likelier as a random string, so that a rare one among very many identifiers still counts. Equal ratios give
    equal results; kinds that begin at one place are in the order of KINDS. A null text counts as empty; both find
    nothing. A repeated row has the same result each time, an empty table an empty one. A column named found is
    replaced, others stay, of whatever name.
    """
    names = [c for c in docs.columns if c != "found"]
    return _scanned(docs.select(packed(docs, names), "text"), samples, threshold).select(*unpacked(names), "found")


def _scanned(docs: DataFrame, samples: DataFrame, threshold: float) -> DataFrame:
    """docs (_docs, text) with found."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = F.split(F.lit(",".join(map(str, ratios(samples)))), ",").cast("array<double>")
    docs = docs.withColumn("_base", F.concat(_places(text, ASSIGN, "assign", 2, ASSIGN_LEAST), _places(text, ACCESS, "access"), _places(text, HEX, "hex")))
    docs = docs.withColumn("_more", _places(text, CANDIDATE, "markov"))
    apart = lambda x: ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    more = F.filter("_more", lambda x: apart(x) & (_ratio(x["value"], table) > threshold))
    return docs.withColumn("found", F.array_sort(F.concat("_base", F.when(F.size("_more") > 0, more).otherwise(F.col("_more"))))).drop("_base", "_more")


def default_samples(docs: DataFrame, rows: int = 4000, max_docs: int = 500) -> DataFrame:
    return generated_samples(docs.sparkSession, rows).unionByName(identifier_samples(docs, max_docs))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, samples: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row for each row of docs.

    Null and empty texts have no spans; repeated rows have a row each; an empty table gives an empty one. Of docs only doc_id
    and text are read.
    """
    docs = docs.select("doc_id", "text")
    found = scan(docs, default_samples(docs) if samples is None else samples, threshold)
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "markov")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), of("markov").alias("n_markov"),
    )


def redact(docs: DataFrame, samples: DataFrame | None = None, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows kept, with every found span replaced by the mask.

    Overlapping spans count as one. n_chars, if there, is counted anew for the texts that change. Null and empty texts stay
    as they are; repeated rows change alike; an empty table gives an empty one. Other columns may have any name.
    """
    names = docs.columns
    found = _scanned(docs.select(packed(docs, names), "text"), default_samples(docs) if samples is None else samples, threshold)
    kept = dict(zip(names, unpacked(names), strict=True))
    text = F.col("text")
    piece = lambda a, b: F.substring(text, a + 1, b - a)

    def step(state: Column, x: Column) -> Column:
        new = x["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(new, F.concat(state["out"], piece(state["at"], x["start"]), F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    state = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    found = found.withColumn("_done", F.when(F.size("found") > 0, state))
    clean = F.when(F.size("found") > 0, F.concat(F.col("_done.out"), F.substring(text, F.col("_done.at") + 1, F.length(text)))).otherwise(text)
    found = found.withColumn("_clean", clean)
    chars = F.when(F.size("found") > 0, F.length("_clean").cast("long")).otherwise(kept["n_chars"]) if "n_chars" in names else None
    return found.select(*[F.col("_clean").alias("text") if c == "text" else chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else kept[c] for c in names])
