"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fim, langid, licenses, lm, mixing, neardup, quality, resampling, secrets, sharding, suffixdedup
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the labels is held out: they teach nothing, and serve to measure."""
    out = langid.held_out(5, 0)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), teaches=~out).withColumn("held_out", out)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85).drop("row_key")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = langid.fit(docs.where(~langid.held_out(4, 2)))
    found = langid.predict(docs.select("doc_id", "text"), fitted)
    return found.select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~langid.held_out(10, 0))
    return found.withColumn("held_out", langid.held_out(10, 0))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("fim_form"), F.col("fim_output")), 256).alias("restored_sha256"),
    )


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return made.select("doc_id", *[F.col(f"dsir_{c}").alias(c if c != "features" else "n_features") for c in ("features", "weight", "score", "rank")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontaminate": op1_decontaminate, "op2_mix": op2_mix, "op3_ann": op3_ann, "op7_suffixdedup": op7_suffixdedup, "op4_secrets": op4_secrets, "op5_quality": op5_quality, "op6_neardup": op6_neardup, "op9_langid": op9_langid, "op8_licenses": op8_licenses, "op10_lm": op10_lm, "op11_fim": op11_fim, "op12_shards": op12_shards, "op13_resample": op13_resample}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win USING (g) WHERE grams.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CASE WHEN len(d.w) > 0 THEN coalesce(n_hit, 0) / len(d.w) ELSE 0.0 END AS coverage
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
c AS (SELECT min(doc_id) AS rep, list_sort(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
x AS (SELECT rep, n, unnest(g) AS v FROM c),
k AS (SELECT v FROM x GROUP BY v HAVING count(*) > 1),
p AS (SELECT a.rep AS i, b.rep AS j, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb FROM (SELECT * FROM x SEMI JOIN k USING (v)) a JOIN x b ON a.v = b.v AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT i, j FROM p WHERE 100 * inter >= 85 * (na + nb - inter)),
t AS (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a),
m AS (SELECT a AS rep, min(b) AS comp FROM r GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id, coalesce(m.comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.rep = c.rep
"""


def _repeats(name: str, size: int) -> str:
    """CTE ``name``: the begin and end of each run of bytes under a string of that size that starts elsewhere too, by row."""
    return f"""
{name}w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * size})) AS g FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {size - 1})) AS i FROM b WHERE length(h) >= {2 * size})),
{name}t AS (SELECT g FROM {name}w GROUP BY g HAVING count(*) > 1),
{name}s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {size} THEN 0 ELSE 1 END AS st FROM {name}w SEMI JOIN {name}t USING (g)),
{name}u AS (SELECT r, run, min(i) AS a, max(i) + {size} AS z FROM (SELECT *, sum(st) OVER (PARTITION BY r ORDER BY i) AS run FROM {name}s) GROUP BY 1, 2),
{name} AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM {name}u GROUP BY 1)"""


OP7_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), {_repeats("v", suffixdedup.LENGTH)}, {_repeats("q", suffixdedup.PASSAGE)}
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(list_sum(v.z) - list_sum(v.a), 0)::BIGINT AS n_removed, coalesce(len(v.a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN v.a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(v.a) + 1), lambda k:
    substr(h, 2 * CASE WHEN k = 0 THEN 0 ELSE v.z[k] END + 1, 2 * (CASE WHEN k = len(v.a) THEN length(h) // 2 ELSE v.a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE v.z[k] END))), '') END)) AS kept_sha256,
  coalesce(list_sum(q.z) - list_sum(q.a), 0)::BIGINT AS n_repeated
FROM b LEFT JOIN v ON b.r = v.r LEFT JOIN q ON b.r = q.r
"""


def _drawn(key: str, digits: int, at: int = 0) -> str:
    """Digits of a SHA-256 as an unsigned integer."""
    return f"('0x' || substr(sha256('{key}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * at + 1}, {digits}))::BIGINT"


OP11_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, {", ".join(f"{_drawn('1', 8, i)} AS h{i + 1}" for i in range(4))} FROM documents),
r AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS z FROM t),
p AS (SELECT doc_id, x, n, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:z], '') AS mid, array_to_string(w[z + 1:n], '') AS suf,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""


#: CRC-32 of bytes written in hexadecimal, as a list of their pairs: the table of 256 remainders made by its rule, then a step a byte.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || list_transform(range(8), lambda k: 0::BIGINT), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS rests)"


def _crc(text: str) -> str:
    pairs = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {pairs}, lambda a, b: xor(a // 256, rests[xor(a, b) % 256 + 1])), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS h, {_crc("coalesce(text, '')")} AS c FROM documents, crc),
g AS (SELECT h, sum(sum(size)) OVER (ORDER BY h)::BIGINT AS e, sum(size)::BIGINT AS b FROM d GROUP BY h),
-- a walk over the groups for a capacity: the end of the shard that begins at a place; then a smaller or a larger capacity
s(lo, hi, pos, k, fits) AS (
  SELECT 1::BIGINT, max(e), 0::BIGINT, 0, false FROM g
  UNION ALL
  SELECT CASE WHEN pos < total AND k = 16 THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN pos = total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN pos = total OR k = 16 THEN 0 ELSE greatest((SELECT coalesce(max(e), 0) FROM g WHERE e <= pos + (lo + hi) // 2), (SELECT min(e) FROM g WHERE e > pos)) END,
    CASE WHEN pos = total OR k = 16 THEN 0 ELSE k + 1 END, false
  FROM s, (SELECT max(e) AS total FROM g) WHERE lo < hi),
cap AS (SELECT max(lo) AS c FROM s WHERE lo = hi),
w(y) AS (SELECT 0::BIGINT UNION ALL SELECT greatest((SELECT coalesce(max(e), 0) FROM g WHERE e <= y + c), (SELECT min(e) FROM g WHERE e > y)) FROM w, cap WHERE y < (SELECT max(e) FROM g)),
p AS (SELECT h, (SELECT count(*) FROM w WHERE y > 0 AND y < e) AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, c::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN p USING (h)
"""


OP13_SQL = f"""
WITH {_CRC_TABLE},
b AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM b),
q AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM (SELECT {_WORDS} AS w FROM benchmark)),
k AS (SELECT x, {_crc("x")} % 10000 AS k FROM (SELECT x FROM f UNION SELECT x FROM q), crc),
s AS (SELECT k, count(*) AS s FROM f JOIN k USING (x) GROUP BY 1),
t AS (SELECT k, count(*) AS t FROM q JOIN k USING (x) GROUP BY 1),
g AS (SELECT i AS k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
v AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (x) JOIN g USING (k) GROUP BY 1),
z AS (SELECT r, doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(({_drawn('7', 8)} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM b LEFT JOIN v USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM z WHERE able)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op6_neardup": OP6_SQL, "op7_suffixdedup": OP7_SQL, "op11_fim": OP11_SQL, "op12_shards": OP12_SQL, "op13_resample": OP13_SQL}
