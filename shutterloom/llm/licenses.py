"""License scan: ordered signature rules over normalised words, in DataFrame functions only.

A text is brought to its lower-cased words with single spaces. Rules are ordered by priority; each has a keyword,
and its pattern is tried only on texts that have that keyword, of which one cheap test for any keyword comes first.
A detection inside another one of a better priority is dropped, also where both take the same words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, packed, unpacked
from .license_rules import RULES

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))



def rules() -> list[tuple[int, str, float, str, str]]:
    """(priority, label, confidence, keyword, pattern), best first; keyword and pattern begin and end at words."""
    made = []
    for line in RULES.strip().splitlines():
        confidence, label, keyword, pattern = (x.strip() for x in line.split(" | "))
        made.append((len(made), label, float(confidence), f" {keyword}", f"(?<= )(?:{pattern})(?= )"))
    return made


_SEP = f"{NOT_WORD}+"
#: How the first words of all rules and base phrases go; a text without any has no detection.
_FIRST = (
    "licen[cs]", "unlicense", "spdx", "cc by", "cc0", "creative commons", "creativecommons", "rights reserved", "copyright", "public domain", "permission (?:is hereby|to use)",
    "redistribut(?:ion|e)", "(?:released|distributed|available|published) under", "apache", "mozilla org", "gnu", "[la]?gpl", "mpl", "epl", "cddl", "wtfpl", "eupl", "ofl", "odbl",
    "gfdl", "openrail", "unencumbered", "proprietary", "without (?:permission|prior|written|express|warrant|even the|a written)", "substantial portions", "endorse or", "as is (?:without|basis)",
    "affero", "do what the", "general public", "action of contract", "advertising materials", "author disclaims", "source versions must", "misrepresented", "openssl", "reserved font",
    "good not evil", "me a beer", "jpeg group", "clause bsd", "bsd (?:[1-4]|style)", "mit no",
)
#: The cheap first test, on lower-cased text before its words are cut.
GATE = f"(?:^|{NOT_WORD})(?:{'|'.join(_FIRST).replace(' ', _SEP)})"


def normalised(text: Column) -> Column:
    """The words of lower-cased text, each between two single spaces; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), _SEP, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words_before(norm: Column, phrase: str) -> Column:
    """The word numbers at which the phrase stands: as many words as spaces come before."""
    parts, size = F.split(norm, f" {phrase}(?= )", -1), phrase.count(" ") + 1

    def step(state: Column, part: Column) -> Column:
        at = state["at"] + _spaces(part)
        return F.struct((at + size).alias("at"), F.concat(state["all"], F.array(at)).alias("all"))

    none = F.array().cast("array<int>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("all")), step)["all"]
    # the last part is followed by no phrase
    return F.when(norm.contains(f" {phrase} "), F.slice(found, 1, F.size(found) - 1)).otherwise(none)


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda at: F.struct(F.lit(label).alias("label"), at.alias("word")))


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, base (array<struct<label, word>>) and detections (array<struct<priority, label, confidence, start, end>>).

    start and end are offsets in the normalised text. A null or empty text has no words and no detections.
    Columns of these names are replaced, others stay, of whatever name; repeated rows are alike, an empty table gives an
    empty one.
    """
    names = [c for c in docs.columns if c not in ("n_words", "base", "detections")]
    docs = docs.select(packed(docs, names), "text")
    named = [dict(zip(("priority", "label", "confidence", "keyword", "pattern"), r, strict=True)) for r in rules()]
    every = F.from_json(F.lit(json.dumps(named)), "array<struct<priority:int,label:string,confidence:double,keyword:string,pattern:string>>")
    norm = F.col("_norm")
    docs = docs.withColumn("_low", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    docs = docs.withColumn("_gate", F.col("_low").rlike(GATE)).withColumn("n_words", F.size(F.array_remove(F.split("_low", _SEP, -1), "")).cast("long"))
    docs = docs.withColumn("_norm", F.when(F.col("_gate"), normalised(F.col("_low"))).otherwise(F.lit(" ")))
    base = F.concat(*[_labelled(_words_before(norm, phrase), label) for phrase, label in BASE])
    docs = docs.withColumn("base", F.when(F.col("_gate"), base).otherwise(F.array().cast("array<struct<label:string,word:int>>")))
    # each keyword is looked for once, and only the rules of those found are tried
    keywords = F.array(*[F.lit(k) for k in sorted({r[3] for r in rules()})])
    docs = docs.withColumn("_found", F.when(F.col("_gate"), F.filter(keywords, lambda k: F.contains(norm, k))))
    near = F.filter(every, lambda r: F.array_contains(F.col("_found"), r["keyword"]))
    kind = "array<struct<priority:int,label:string,confidence:double,start:int,end:int>>"

    def places(r: Column) -> Column:
        """All places of a rule: one run of its pattern sets marks, which no normalised text has, and what lies between them adds up."""
        parts = F.split(F.regexp_replace(norm, r["pattern"], F.lit("\x01$0\x02")), "[\x01\x02]", -1)

        def step(state: Column, x: Column, i: Column) -> Column:
            end = state["at"] + F.length(x)
            one = F.struct(r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"), state["at"].alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(i % 2 == 1, F.concat(state["all"], F.array(one))).otherwise(state["all"]).alias("all"))

        numbered = F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.aggregate(numbered, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all")), lambda s, x: step(s, x["x"], x["i"]))["all"]

    # _found is named twice, so that it is not worked out again for every rule
    docs = docs.withColumn("_all", F.when(F.size("_found") > 0, F.flatten(F.transform(near, places))).otherwise(F.array().cast(kind)))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["priority"] < x["priority"])
    return docs.withColumn("detections", F.filter("_all", lambda x: ~F.exists("_all", lambda y: inside(x, y)))).select(*unpacked(names), "n_words", "base", "detections")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (a string): one row for each document.

    labels unites the base phrases' and the rules'. score is 1 - the product of (1 - confidence) over what was found,
    0.8 for a base phrase.
    """
    found = scan(docs.select("doc_id", "text"))
    at = F.transform("base", lambda x: x["word"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    more = F.transform("detections", lambda x: x["label"])
    miss = F.aggregate("detections", F.when(F.size("base") > 0, F.lit(0.2)).otherwise(F.lit(1.0)), lambda a, x: a * (1 - x["confidence"]))
    shown = F.array_join(F.transform(F.array_sort("detections"), lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        (1 - miss).alias("score"), shown.alias("detections"),
    )
