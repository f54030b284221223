"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr, formats
from ..operators import inputs, islands, ratings, storage, summaries, verdict, winner
from ..operators.ordering import numbered, settled
from ..sources import settings
from . import journal, sidecars  # noqa: F401  they register their queries
from .frames import BURST, BURST_INPUTS, FRAMES_SQL, SIMILAR, WINNER_INPUTS, frames, grouped, judged, scored, table
from .registry import _SQL, oracle_sql, queries  # noqa: F401
from .registry import query as _query


@_query(f"WITH {FRAMES_SQL} SELECT id, path, ord FROM f")
def capture_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir, "id").select("id", "path", "ord")


@_query(f"WITH {FRAMES_SQL} SELECT id, burst_group, burst_pos, burst_len FROM b WHERE burst_group IS NOT NULL")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands.bursts(frames(spark, sf_dir, *BURST_INPUTS), BURST)
    return rows.where("burst_group is not null").select("id", "burst_group", "burst_pos", "burst_len")


@_query(f"WITH {FRAMES_SQL} SELECT id, sim_group, sim_pos, sim_len FROM s WHERE sim_group IS NOT NULL")
def similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).where("sim_group is not null").select("id", "sim_group", "sim_pos", "sim_len")


@_query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT a.*, CASE WHEN t - lag(t) OVER w < 3600000 THEN 0 ELSE 1 END AS st FROM e a WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY i) AS run FROM g)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY i) AS BIGINT) AS pos, len FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS len FROM r) WHERE len >= 2
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = expr.epoch_ms(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", t.alias("t"))
    rows = rows.withColumn("_s", F.when(F.col("t") - F.lag("t").over(w) < 3_600_000, 0).otherwise(1)).withColumn("run", F.sum("_s").over(w))
    run = Window.partitionBy("user_id", "run")
    rows = rows.withColumn("len", F.count(F.lit(1)).over(run)).withColumn("pos", F.row_number().over(run.orderBy("ts", "event_id")).cast("long"))
    return rows.where("len >= 2").select("user_id", "event_id", "pos", "len")


_WIN = """
w0 AS (SELECT src_folder, ord, id, af, global_sharpness, clip_sum, ord // 8 AS grp, scored, decode_ok_eligible AS eligible FROM (SELECT *, af >= 0.55 AND exposure_score >= 0.6 AND least(af, exposure_score) >= 0.5 AS decode_ok_eligible FROM f)),
w1 AS (SELECT *, bool_and(scored) OVER (PARTITION BY grp) AS every FROM w0),
w2 AS (SELECT grp, id, af, row_number() OVER (PARTITION BY grp ORDER BY af DESC, global_sharpness DESC, clip_sum, ord) AS r FROM w1 WHERE every AND eligible)
"""


@_query(f"WITH {FRAMES_SQL}, {_WIN} SELECT g.grp, w2.id AS winner_id, w2.af AS winner_af FROM (SELECT DISTINCT grp FROM w0) g LEFT JOIN w2 ON w2.grp = g.grp AND r = 1")
def winners_without_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With no faces the ladder is a total order, which SQL can sort by."""
    rows = frames(spark, sf_dir, "id", *WINNER_INPUTS).withColumns({"grp": F.floor(F.col("ord") / 8), "eligible": verdict.keep_eligible(0.5), "eyes_open": F.lit(None).cast("double"), "face_sharpness": F.lit(None).cast("double")})
    return winner.winners(rows, "grp")


_FOLD = """
k1 AS (SELECT *, af >= 0.55 AND exposure_score >= 0.6 AND least(af, exposure_score) >= 0.5 AS eligible FROM b WHERE burst_group IS NOT NULL),
k2 AS (SELECT burst_group, bool_and(scored) AS every, list({'id': id, 'eyes': eyes_open, 'face': face_sharpness, 'af': af, 'gs': global_sharpness, 'clip': clip_sum} ORDER BY ord) FILTER (WHERE eligible) AS m FROM k1 GROUP BY 1),
k3 AS (SELECT burst_group, CASE WHEN every AND len(m) > 0 THEN list_reduce(m, lambda w, x:
  CASE WHEN CASE
    WHEN w.eyes IS NOT NULL AND x.eyes IS NOT NULL AND (x.eyes >= 0.5) <> (w.eyes >= 0.5) THEN x.eyes >= 0.5
    WHEN w.face IS NOT NULL AND x.face IS NOT NULL AND x.face <> w.face THEN x.face > w.face
    WHEN x.af <> w.af THEN x.af > w.af WHEN x.gs <> w.gs THEN x.gs > w.gs ELSE x.clip < w.clip END THEN x ELSE w END) END AS best FROM k2)
"""


@_query(f"WITH {FRAMES_SQL}, {_FOLD} SELECT burst_group, best.id AS winner_id, best.af AS winner_af FROM k3")
def burst_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder, folded in order."""
    rows = islands.bursts(frames(spark, sf_dir, *BURST_INPUTS, *WINNER_INPUTS), BURST)
    return winner.winners(rows.withColumn("eligible", verdict.keep_eligible(0.5)), "burst_group")


def _verdict_sql(source: str, groups: bool, level: float = 0.5, decoded: str = "true") -> str:
    """CTE v3: the cascade over ``source``, which has the groups' columns if there are any, for a level."""
    loser = lambda p, scale, floor: f"CASE WHEN {p}_group IS NOT NULL AND NOT {p}_is_winner AND {p}_margin > {floor} THEN least(1.0, greatest(0.0, ({p}_margin - {floor}) / {scale})) ELSE 0.0 END" if groups else "0.0"
    lost = "(burst_group IS NOT NULL AND NOT burst_is_winner) OR (sim_group IS NOT NULL AND NOT sim_is_winner)" if groups else "false"
    return f"""
v1 AS (SELECT *, CASE WHEN af < 0.12 AND af_texture >= 0.12 THEN least(1.0, greatest(0.0, (0.12 - af) / 0.12 * (CASE WHEN af_valid THEN 1.0 ELSE 0.5 END) * (CASE WHEN abs(tenengrad - af) > 0.35 THEN 0.6 ELSE 1.0 END))) ELSE 0.0 END AS soft0,
  {loser("burst", 0.25, 0.0)} AS burst_c, {loser("sim", 0.35, 0.05)} AS sim_c,
  CASE WHEN eyes_open >= 0 AND eyes_open < 0.2 THEN least(1.0, (0.2 - eyes_open) / 0.2) ELSE 0.0 END AS eyes FROM {source}),
v2 AS (SELECT *, CASE WHEN soft0 = 0 AND global_texture >= 0.12 AND global_sharpness < 0.13 AND tenengrad < 0.2 THEN least(1.0, greatest(0.0, (2 * 0.2 - tenengrad) / (2 * 0.2))) ELSE 0.0 END AS blur FROM v1),
v2b AS (SELECT *, list_reverse_sort([greatest(soft0, blur), burst_c, eyes, sim_c]::DOUBLE[]) AS c FROM v2),
v2c AS (SELECT *, c[1] + 0.1 * c[2] + 0.05 * c[3] + 0.05 * c[4] AS c0 FROM v2b),
v3 AS (SELECT *, CASE WHEN c0 > 0 THEN least(1.0, c0 + CASE WHEN blown_pct >= 0.25 THEN 0.05 ELSE 0 END + CASE WHEN crushed_pct >= 0.35 THEN 0.05 ELSE 0 END) ELSE 0 END AS c1,
  {decoded} AND af >= 0.55 AND exposure_score >= 0.6 AND least(af, exposure_score) >= {level} AND NOT ({lost}) AS keep, {decoded} AS decoded FROM v2c)
"""


_VERDICT = _verdict_sql("f", False)
_GROUP_REASONS = "CASE WHEN burst_c > 0 THEN 'not best of burst (' || burst_pos || ' of ' || burst_len || ')' END, CASE WHEN sim_c > 0 THEN 'not best of similar set (' || sim_pos || ' of ' || sim_len || ')' END, "


def _emitted(groups: bool, level: float = 0.5) -> str:
    best = "CASE WHEN sim_is_winner THEN 'best of similar set' END, CASE WHEN burst_is_winner THEN 'best of burst' END, " if groups else ""
    return f"""id, CASE WHEN decoded AND c1 > 0 THEN CASE WHEN c1 >= {level} THEN 'reject' END WHEN keep THEN 'keep' END AS verdict,
  round(CASE WHEN decoded AND c1 > 0 THEN c1 WHEN keep THEN least(af, exposure_score) ELSE 0.0 END, 6) AS confidence,
  CASE WHEN decoded AND c1 > 0 THEN concat_ws('; ', CASE WHEN soft0 > 0 THEN CASE WHEN motion_blur_likelihood > 0.5 THEN 'motion blur' ELSE 'soft focus' END END, CASE WHEN blur > 0 THEN 'heavy blur' END, {_GROUP_REASONS if groups else ""}
    CASE WHEN eyes > 0 THEN 'closed eyes' END, CASE WHEN blown_pct >= 0.25 THEN 'blown highlights' END, CASE WHEN crushed_pct >= 0.35 THEN 'crushed shadows' END)
    WHEN keep THEN concat_ws('; ', {best}'sharp, well exposed') ELSE '' END AS reasons"""


def _fold_sql(source: str, prefix: str, level: float = 0.5, decoded: str = "true") -> str:
    """CTE {prefix}_j: ``source`` with is_winner and margin of its groups, by a fold in order."""
    return f"""
{prefix}_k1 AS (SELECT *, {decoded} AND af >= 0.55 AND exposure_score >= 0.6 AND least(af, exposure_score) >= {level} AS eligible FROM {source}),
{prefix}_k2 AS (SELECT {prefix}_group AS kg, bool_and(scored) AS every, list({{'id': id, 'eyes': eyes_open, 'face': face_sharpness, 'af': af, 'gs': global_sharpness, 'clip': clip_sum}} ORDER BY ord) FILTER (WHERE eligible) AS m
  FROM {prefix}_k1 WHERE {prefix}_group IS NOT NULL GROUP BY 1),
{prefix}_k3 AS (SELECT kg, CASE WHEN every AND len(m) > 0 THEN list_reduce(m, lambda w, x:
  CASE WHEN CASE
    WHEN w.eyes IS NOT NULL AND x.eyes IS NOT NULL AND (x.eyes >= 0.5) <> (w.eyes >= 0.5) THEN x.eyes >= 0.5
    WHEN w.face IS NOT NULL AND x.face IS NOT NULL AND x.face <> w.face THEN x.face > w.face
    WHEN x.af <> w.af THEN x.af > w.af WHEN x.gs <> w.gs THEN x.gs > w.gs ELSE x.clip < w.clip END THEN x ELSE w END) END AS best FROM {prefix}_k2),
{prefix}_j AS (SELECT t.*, coalesce(best.id = t.id, false) AS {prefix}_is_winner, CASE WHEN coalesce(best.id = t.id, false) THEN 0.0 ELSE coalesce(best.af - t.af, 0.0) END AS {prefix}_margin
  FROM {source} t LEFT JOIN {prefix}_k3 ON {prefix}_group = kg)"""


@_query(f"WITH {FRAMES_SQL}, {_fold_sql('s', 'burst')}, {_fold_sql('burst_j', 'sim')}, {_verdict_sql('sim_j', True)} SELECT {_emitted(True)}, burst_is_winner, round(burst_margin, 6) AS burst_margin FROM v3")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    return rows.select("id", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"), "burst_is_winner", F.round("burst_margin", 6).alias("burst_margin"))


@_query(f"WITH {FRAMES_SQL}, {_fold_sql('s', 'burst', 0.65)}, {_fold_sql('burst_j', 'sim', 0.65)}, {_verdict_sql('sim_j', True, 0.65)} SELECT {_emitted(True, 0.65)} FROM v3")
def verdicts_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the level that counts unless another is chosen."""
    return _shown(judged(spark, sf_dir, "medium"))


_FACES = "array<struct<bbox:array<double>,eyes_open:double,face_sharpness:double>>"
#: Every nineteenth frame did not decode.
_ODD = "(id % 19 <> 0)"


@_query(f"""WITH {FRAMES_SQL}, {_fold_sql('s', 'burst', 0.8, _ODD)}, {_fold_sql('burst_j', 'sim', 0.8, _ODD)}, fo AS (SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN 0.05::DOUBLE ELSE eyes_open END AS eyes_open) FROM sim_j),
{_verdict_sql('fo', True, 0.8, _ODD)} SELECT {_emitted(True, 0.8)} FROM v3""")
def verdicts_high_of_odd_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the highest level, with frames that did not decode and with several faces in a frame, of which the largest counts."""
    e = F.col("id")
    face = lambda side, eyes: F.struct(F.array(F.lit(0.1), F.lit(0.1), F.lit(side), F.lit(side)).alias("bbox"), F.lit(eyes).alias("eyes_open"), F.lit(0.5).alias("face_sharpness"))
    more = F.array(face(0.0, 0.01), face(0.4, 0.05), face(0.4, 0.9))
    return _shown(judged(spark, sf_dir, "high", {"decode_ok": e % 19 != 0, "faces": F.when(e % 6 == 0, F.concat(F.coalesce("faces", F.array().cast(_FACES)), more)).otherwise(F.col("faces"))}))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"))


_NEAR_SQL = f"""
m AS (SELECT b.*, CASE WHEN id % 5 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS emb FROM b LEFT JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings)),
m1 AS (SELECT *, lag(m) OVER (ORDER BY ord) AS p FROM m),
m2 AS (SELECT id, ord, CASE WHEN has_input AND p.has_input AND burst_group IS NULL AND p.burst_group IS NULL AND src_folder = p.src_folder AND abs(captured_ms - p.captured_ms) <= {SIMILAR.window_ms}
  AND (bit_count(xor(h, p.h)) <= 4 OR coalesce(list_dot_product(emb, p.emb) >= 0.2, false)) THEN 0 ELSE 1 END AS st FROM m1),
m3 AS (SELECT *, sum(st) OVER (ORDER BY ord) AS run FROM m2)"""


@_query(f"WITH {FRAMES_SQL}, {_NEAR_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY run ORDER BY ord) AS INTEGER) AS sim_pos, CAST(n AS INTEGER) AS sim_len FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM m3) WHERE n >= 2")
def similar_by_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that hash or embedding links, where the embeddings come from their table; some frames have none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = islands.bursts(frames(spark, sf_dir, *BURST_INPUTS, "phash"), BURST).join(F.broadcast(n))
    rows = rows.join(vectors, F.col("id") % F.col("n") == F.col("vec_id"), "left").withColumn("embedding", F.when(F.col("id") % 5 != 0, F.col("embedding"))).drop("vec_id", "n")
    made = islands.similar_sets(settled(rows), islands.SimilarRule(SIMILAR.window_ms, 4, 0.2))
    return made.where("sim_group is not null").select("id", "sim_pos", "sim_len")


@_query(f"WITH {FRAMES_SQL}, {_VERDICT} SELECT {_emitted(False)} FROM v3")
def verdicts_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade for frames outside of any group."""
    none = {f"{p}_{c}": F.lit(v).cast(t) for p in ("burst", "sim") for c, v, t in (("group", None, "int"), ("pos", None, "int"), ("len", None, "int"), ("is_winner", False, "boolean"), ("margin", 0.0, "double"))}
    rows = verdict.with_verdict(scored(spark, sf_dir).withColumns(none), "low")
    return rows.select("id", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"))


@_query(f"""WITH {FRAMES_SQL}, {_VERDICT}, fav AS (SELECT id, row_number() OVER (ORDER BY aesthetic DESC, id) AS r FROM v3 WHERE c1 = 0 AND keep AND aesthetic >= 0.55)
SELECT id FROM fav WHERE r <= (SELECT least(15, greatest(3, ceil(count(*) * 0.05))) FROM f)""")
def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {f"{p}_{c}": F.lit(v).cast(t) for p in ("burst", "sim") for c, v, t in (("group", None, "int"), ("pos", None, "int"), ("len", None, "int"), ("is_winner", False, "boolean"), ("margin", 0.0, "double"))}
    rows = verdict.with_favourites(verdict.with_verdict(scored(spark, sf_dir).withColumns(none), "low"))
    return rows.where("verdict = 'favorite'").select("id")


@_query(f"""WITH {FRAMES_SQL}, v AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i, CASE WHEN burst_group IS NOT NULL THEN 'burst' WHEN sim_group IS NOT NULL THEN 'similar' END AS kind,
  coalesce(burst_group, sim_group) AS grp, coalesce(burst_len, sim_len) AS len FROM s WHERE rating IS NULL),
k AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY kind, grp ORDER BY i) = 1 THEN 0 ELSE 1 END AS st FROM v WHERE kind IS NOT NULL),
n AS (SELECT *, sum(st) OVER (PARTITION BY kind, grp ORDER BY i) AS nth FROM k),
g AS (SELECT kind, grp, nth, min(i) AS seg_start, max(i) AS e, count(*) AS n, max(len) AS len FROM n GROUP BY ALL)
SELECT row_number() OVER (ORDER BY seg_start) - 1 AS seg_id, kind, grp, seg_start, n, nth = 1 AS labelled, len,
  CASE WHEN lag(e) OVER (ORDER BY seg_start) + 1 = seg_start THEN 6 ELSE 10 END AS gap_before FROM g""")
def display_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.segments(grouped(spark, sf_dir, "rating").where("rating is null"))


@_query(f"""WITH {FRAMES_SQL} SELECT id, ord, min(CASE WHEN rating IS NULL THEN ord END) OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_unrated,
  max(CASE WHEN rating IS NULL THEN ord END) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_unrated FROM f""")
def unrated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.neighbours(frames(spark, sf_dir, "id", "rating")).select("id", "ord", "next_unrated", "previous_unrated")


@_query(f"WITH {FRAMES_SQL} SELECT ord FROM f WHERE rating = 'keep' ORDER BY abs(ord - 500), ord LIMIT 1")
def snapped_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir, "rating")
    return ratings.snapped(rows.where(ratings.passes("keeps", F.col("rating"), F.lit(None)) & (F.col("rating") == "keep")), 500)


@_query(f"WITH {FRAMES_SQL}, e AS (SELECT ord FROM f WHERE id IN (30, 60)) SELECT id, ord FROM f WHERE rating IS NOT NULL AND ord BETWEEN (SELECT min(ord) FROM e) AND (SELECT max(ord) FROM e)")
def range_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.between(frames(spark, sf_dir, "id", "rating").where("rating is not null"), 30, 60).select("id", "ord")


@_query(f"""WITH {FRAMES_SQL}, {_VERDICT}, x AS (SELECT rating, CASE WHEN c1 > 0 THEN CASE WHEN c1 >= 0.5 THEN 'reject' END WHEN keep THEN 'keep' END AS verdict FROM v3)
SELECT count(*) AS total, count(rating) AS rated, count(*) - count(rating) AS unrated, count(*) FILTER (WHERE rating IN ('keep', 'favorite')) AS keeps, count(*) FILTER (WHERE rating = 'favorite') AS favorites,
  count(*) FILTER (WHERE rating = 'reject') AS rejects, count(*) FILTER (WHERE rating IS NULL AND verdict IS NOT NULL) AS suggested FROM x""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    given = rows.where("rating is not null").select(F.col("id").alias("img_id"), "rating")
    return ratings.counts(rows, given, verdicts_alone(spark, sf_dir).where("verdict is not null"))


@_query(f"WITH {FRAMES_SQL} SELECT 'keeps' AS mode, id FROM f WHERE rating IN ('keep', 'favorite') UNION ALL SELECT 'unrated', id FROM f WHERE rating IS NULL UNION ALL SELECT 'rejects', id FROM f WHERE rating = 'reject' UNION ALL SELECT 'favorites', id FROM f WHERE rating = 'favorite'")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    modes = ("keeps", "unrated", "rejects", "favorites")
    shown = F.array_compact(F.array(*[F.when(ratings.passes(m, F.col("rating"), F.lit(None)), F.lit(m)) for m in modes]))
    return rows.select("id", F.explode(shown).alias("mode"))


@_query("""WITH a AS (SELECT event_id AS seq, user_id AS img_id, CASE event_id // 3 % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 2 THEN 'favorite' END AS before, CASE event_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 2 THEN 'favorite' END AS after FROM events)
SELECT img_id, arg_max_null(after, seq) AS rating FROM a WHERE before IS DISTINCT FROM after GROUP BY 1 HAVING rating IS NOT NULL""")
def rating_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    mark = lambda n: F.when(n % 4 == 0, "keep").when(n % 4 == 1, "reject").when(n % 4 == 2, "favorite")
    log = table(spark, sf_dir, "events").select(e.alias("seq"), F.col("user_id").alias("img_id"), mark(F.floor(e / 3)).alias("before"), mark(e).alias("after"))
    return ratings.current(log)


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT vec_id * 2 FROM embeddings) AND doc_id NOT IN (SELECT page_id * 3 FROM pages)")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is neither rated nor scored nor tried."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    rated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("img_id"))
    made, tried = (table(spark, sf_dir, name).select((F.col(key) * n).alias("id")) for name, key, n in (("embeddings", "vec_id", 2), ("pages", "page_id", 3)))
    return ratings.work_list(docs, rated, made, tried).select(F.col("id").alias("doc_id"))


@_query("""SELECT CASE WHEN quality IS NULL THEN 'unlabeled' WHEN n_chars < 1000 AND quality = 0 THEN 'hit' WHEN n_chars < 1000 THEN 'false_reject' WHEN quality = 0 THEN 'miss' ELSE 'quiet' END AS outcome, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 1000, "reject").alias("verdict"))
    return ratings.confusion(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("rejected")))


@_query("""WITH e AS (SELECT doc_id AS used, source || '/' || doc_id AS path, n_chars AS bytes FROM documents),
c AS (SELECT *, sum(bytes) OVER () AS total, coalesce(sum(bytes) OVER (ORDER BY used, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT path, used, bytes FROM c WHERE total > 1500000 AND total - before > 1500000 * 0.9""")
def lru_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("doc_id").alias("used"), F.col("n_chars").alias("bytes"))
    return storage.evicted(entries, 1_500_000)


@_query("""WITH k AS (SELECT user_id % 40 AS key, epoch_us(max(ts)) // 1000000 AS last_opened, count(*) AS n FROM events GROUP BY 1)
SELECT key, last_opened, n FROM k WHERE last_opened >= (SELECT max(last_opened) FROM k) - 14 * 86400 ORDER BY last_opened DESC, key LIMIT 5""")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("key")).agg(F.max("ts").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = e.select(F.array(F.lpad(F.col("key").cast("string"), 3, "0"), F.lit("x")).alias("paths"), "key", "n", F.col("t").cast("string").alias("last_opened"))
    now = e.agg(F.max(F.col("t").cast("timestamp")).alias("now"))
    made = storage.recents(rows.join(F.broadcast(now)), F.col("now"))
    return made.select("key", F.floor(expr.epoch_ms(F.col("last_opened").cast("timestamp_ntz")) / 1000).alias("last_opened"), "n")


@_query(f"WITH {FRAMES_SQL} SELECT src_folder, min(ord) AS first_ord, count(*) AS n, count(rating) AS rated FROM f GROUP BY 1")
def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.folders(frames(spark, sf_dir, "src_folder", "rating"))


@_query(f"WITH {FRAMES_SQL} SELECT coalesce(min(ord) FILTER (WHERE rating IS NULL), 0) AS ord FROM f")
def resume_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.resume_position(frames(spark, sf_dir, "rating"))


@_query("""WITH w AS (SELECT 'in/' || source || '/' || (doc_id % 400) || '.cr3' AS source, 'out/' || (doc_id % 400) || '.cr3' AS dest FROM documents),
d AS (SELECT DISTINCT * FROM w), ex AS (SELECT DISTINCT 'in/' || source || '/' || (doc_id % 400) || '.cr3' AS path FROM documents WHERE doc_id % 3 <> 0 UNION SELECT 'out/' || (doc_id % 400) || '.cr3' FROM documents WHERE doc_id % 400 < 40)
SELECT source, dest, CASE WHEN source NOT IN (SELECT path FROM ex) THEN 'skip_missing' WHEN dest IN (SELECT path FROM ex) OR row_number() OVER (PARTITION BY dest ORDER BY source) > 1 THEN 'skip_exists' ELSE 'do' END AS action FROM d""")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    name = F.concat((F.col("doc_id") % 400).cast("string"), F.lit(".cr3"))
    inner = F.concat(F.lit("in/"), F.col("source"), F.lit("/"), name).alias("path")
    there = docs.where("doc_id % 3 <> 0").select(inner).union(docs.where("doc_id % 400 < 40").select(F.concat(F.lit("out/"), name)))
    return storage.transfer_plan(docs.select(inner), there, "out")


@_query("""SELECT p_partkey, CASE WHEN s > 0 THEN CASE WHEN s >= 1 THEN printf('%.1fs', s) ELSE '1/' || CAST(floor(1 / s + 0.5) AS BIGINT) || 's' END END AS shutter,
  'ƒ/' || regexp_replace(CAST(f AS VARCHAR), '[.]0$', '') AS aperture, CAST(p_size * 100 AS VARCHAR) AS iso, CAST(floor(f * 10 + 0.5) AS BIGINT) || ' mm' AS focal,
  CASE p_size % 3 WHEN 0 THEN 'AWB' WHEN 1 THEN 'WB manual' END AS wb, CASE WHEN abs(ev) < 0.05 THEN '±0 EV' ELSE printf('%+.1f EV', ev) END AS bias, CASE WHEN abs(ev) < 0.05 THEN '±0' ELSE printf('%+.1f', ev) END AS bias_short,
  CASE WHEN p_partkey > 0 THEN printf('%.1f MB', p_partkey * 4099 / 1048576.0) END AS size, p_size || ' × ' || (p_size * 3) AS dims,
  concat_ws(', ', p_size || ' × ' || (p_size * 3), CASE WHEN p_partkey > 0 THEN printf('%.1f MB', p_partkey * 4099 / 1048576.0) END) AS image_size
FROM (SELECT *, p_size / 37.0::DOUBLE AS s, p_size / 4.0::DOUBLE AS f, (p_size - 25) / 7.0::DOUBLE AS ev FROM part)""")
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, mb = F.col("p_size"), F.col("p_partkey") * 4099
    f, ev = size / 4.0, (size - 25) / 7.0
    return table(spark, sf_dir, "part").select(
        "p_partkey", formats.shutter(size / 37.0).alias("shutter"), formats.aperture(f).alias("aperture"), formats.iso(size * 100).alias("iso"), formats.focal(f * 10).alias("focal"),
        formats.white_balance(size % 3).alias("wb"), formats.exposure_bias(ev).alias("bias"), formats.exposure_bias_short(ev).alias("bias_short"),
        formats.file_size(mb).alias("size"), formats.dimensions(size, size * 3).alias("dims"), formats.image_size(size, size * 3, mb).alias("image_size"),
    )


@_query("""WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS then_ms, floor((1722470400000 - epoch_us(ts) // 1000) / 1000 + 0.5) AS s FROM events),
u AS (SELECT *, CAST(floor(s / 60) AS BIGINT) AS m, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor(s / 86400) AS BIGINT) AS d, CAST(floor(s / 604800) AS BIGINT) AS w FROM t)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN CASE m WHEN 1 THEN '1 minute ago' ELSE m || ' minutes ago' END WHEN h < 24 THEN CASE h WHEN 1 THEN '1 hour ago' ELSE h || ' hours ago' END
  WHEN d < 2 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN w = 1 THEN 'last week' WHEN w < 5 THEN w || ' weeks ago' ELSE strftime(make_timestamp(then_ms * 1000), '%b %-d, %Y') END AS ago,
  strftime(make_timestamp(then_ms * 1000), '%H:%M:%S') AS at_time FROM u""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a fixed now."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", formats.relative_time(expr.epoch_ms(ts), F.lit(1_722_470_400_000)).alias("ago"), formats.time_of_day(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).alias("at_time"))


@_query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), url) AS base, regexp_replace(regexp_replace(left(regexp_replace(url, '[<>:"/\\|?*]', '', 'g'), 32), '^ +', ''), '[. ]+$', '') AS folder,
  CASE WHEN length(url) <= 20 THEN url ELSE left(url, 10) || '…' || right(url, 9) END AS short, regexp_replace(url, '[.][^.]+$', '') AS stem,
  CASE WHEN length(url) <= 20 THEN url ELSE '…' || CASE WHEN regexp_matches(right(url, 19), '/.') THEN regexp_extract(right(url, 19), '/.+$') ELSE right(url, 19) END END AS tail FROM pages""")
def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", formats.basename(url).alias("base"), formats.sanitised_folder(url).alias("folder"), formats.middle_truncated(url, 20).alias("short"), formats.strip_ext(url).alias("stem"), formats.tail_path(url, 20).alias("tail")
    )


@_query("""WITH n AS (SELECT o_custkey AS k, list('f' || o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1),
p AS (SELECT k, v, i, array_to_string(v[1:i], ' + ') AS acc, len(v) - i AS rest FROM (SELECT k, v, unnest(range(1, len(v) + 1)) AS i FROM n)),
q AS (SELECT *, i = 1 OR length(acc) + CASE WHEN rest > 0 THEN length(' +' || rest || ' more') ELSE 0 END <= 24 AS fits FROM p),
z AS (SELECT k, i, acc, rest FROM q WHERE i < coalesce((SELECT min(x.i) FROM q x WHERE x.k = q.k AND NOT x.fits), 1000000))
SELECT k AS custkey, arg_max(acc || CASE WHEN rest > 0 THEN ' +' || rest || ' more' ELSE '' END, i) AS folders FROM z GROUP BY 1""")
def folder_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return rows.select("custkey", formats.folder_set(F.transform("v", lambda x: F.concat(F.lit("in/f"), x.cast("string"))), 24).alias("folders"))


_INPUTS = """
i AS (SELECT event_id AS id, 'p' || event_id AS path, event_type AS src_folder FROM events),
sc AS (SELECT event_id AS id, event_id % 5 <> 0 AS decode_ok, least(value / 100, 1.0) AS af, CAST(event_id % 4 AS INTEGER) AS drive_mode, epoch_us(ts) // 1000 AS captured_ms, epoch_us(ts) // 1000 + 5 AS mtime_ms,
  event_id % 7 / 10.0::DOUBLE - 0.1 AS eyes FROM events WHERE event_id % 3 <> 0),
me AS (SELECT 'p' || event_id AS path, CAST(event_id % 3 AS INTEGER) AS drive_mode, (epoch_us(ts) // 1000000) * 1000 + event_id % 1000 AS captured_ms, 'h' || (event_id % 50) AS phash FROM events WHERE event_id % 2 = 0)
"""


def _scored_and_described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, their scores where there are some, and their metadata where there is some."""
    e, events = F.col("event_id"), table(spark, sf_dir, "events")
    path, ms = F.concat(F.lit("p"), e.cast("string")).alias("path"), expr.epoch_ms(F.col("ts"))
    none = F.lit(None).cast("double")
    eyes = F.struct(F.array(*[F.lit(0.1)] * 4).alias("bbox"), (e % 7 / 10.0 - 0.1).alias("eyes_open"), F.lit(0.5).alias("face_sharpness"))
    scores = events.where(e % 3 != 0).select(
        e.alias("id"), (e % 5 != 0).alias("decode_ok"), F.least(F.col("value") / 100, F.lit(1.0)).alias("af"), F.lit(0.5).alias("global_sharpness"), F.lit(0.1).alias("blown_pct"), F.lit(0.1).alias("crushed_pct"), F.array(eyes).alias("faces"),
        (e % 4).cast("int").alias("drive_mode"), F.lit(85.0).alias("focal_mm"), ms.alias("captured_ms"), F.lit(0).alias("sub_sec_ms"), (ms + 5).alias("mtime_ms"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    known = events.where(e % 2 == 0).select(
        path, (e % 3).cast("int").alias("drive_mode"), none.alias("focal_mm"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("captured_at"), (e % 1000).cast("int").alias("sub_sec_ms"), F.concat(F.lit("h"), (e % 50).cast("string")).alias("phash")
    )
    return events.select(e.alias("id"), path, F.col("event_type").alias("src_folder")), scores, known


@_query(f"""WITH {_INPUTS}
SELECT i.id, src_folder, coalesce(decode_ok, false) OR me.path IS NOT NULL AS has_input, coalesce(decode_ok, false) AS scored, CASE WHEN decode_ok THEN sc.drive_mode ELSE me.drive_mode END AS drive_mode,
  CASE WHEN decode_ok THEN sc.captured_ms ELSE me.captured_ms END AS captured_ms, CASE WHEN decode_ok THEN mtime_ms END AS mtime_ms, CASE WHEN decode_ok THEN af END AS af, CASE WHEN decode_ok AND eyes >= 0 THEN round(eyes, 6) END AS eyes_open
FROM i LEFT JOIN sc ON i.id = sc.id LEFT JOIN me ON i.path = me.path""")
def burst_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.burst_inputs(*_scored_and_described(spark, sf_dir))
    return rows.select("id", "src_folder", "has_input", "scored", "drive_mode", "captured_ms", "mtime_ms", "af", F.round("eyes_open", 6).alias("eyes_open"))


@_query(f"""WITH {_INPUTS}
SELECT i.id, coalesce(decode_ok, false) OR me.path IS NOT NULL AS has_input, CASE WHEN decode_ok THEN sc.captured_ms ELSE me.captured_ms END AS captured_ms, CASE WHEN decode_ok THEN mtime_ms END AS mtime_ms, phash
FROM i LEFT JOIN sc ON i.id = sc.id LEFT JOIN me ON i.path = me.path""")
def similar_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.similar_inputs(*_scored_and_described(spark, sf_dir)).drop("embedding")


@_query(f"WITH {FRAMES_SQL} SELECT id FROM f WHERE rating IS NULL AND id % 3 = 0")
def selected_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return inputs.selected(rows.where("rating is null"), rows.where("id % 3 = 0")).select("id")


@_query(f"WITH {FRAMES_SQL} SELECT id, id <> 60 AS candidate FROM f WHERE id = 60 OR rating IS NULL")
def compare_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.compare_candidates(scored(spark, sf_dir).select("id", "rating"), 60).select("id", "candidate")


@_query(f"WITH {FRAMES_SQL}, c AS (SELECT ord AS a FROM f WHERE id = 61) SELECT coalesce(min(ord) FILTER (WHERE ord > a), max(ord) FILTER (WHERE ord < a)) AS ord FROM f, c WHERE rating IS NULL AND id NOT IN (60, 61)")
def next_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.next_challenger(frames(spark, sf_dir, "id", "rating"), 61, 60)


@_query(f"WITH {FRAMES_SQL} SELECT (SELECT min(ord) FROM f WHERE rating IS NULL AND ord > 500 AND id <> 70) AS ahead, (SELECT max(ord) FROM f WHERE rating IS NULL AND ord < 500 AND id <> 70) AS behind")
def unrated_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir, "id", "rating")
    ahead, behind = (ratings.unrated_from(rows, 500, d, 70) for d in (1, -1))
    return ahead.withColumnRenamed("ord", "ahead").join(F.broadcast(behind.withColumnRenamed("ord", "behind")))  # one row each


@_query(f"""WITH {FRAMES_SQL}, x AS (SELECT ord, CASE WHEN id % 9 <> 0 THEN captured_ms END AS t, CASE WHEN id % 5 <> 0 THEN h END AS h, CASE WHEN id % 4 <> 0 THEN [af, tenengrad] END AS e FROM f),
y AS (SELECT *, lag(t) OVER w AS pt, lag(h) OVER w AS ph, lag(e) OVER w AS pe FROM x WINDOW w AS (ORDER BY ord))
SELECT ord, coalesce(abs(t - pt), -1) AS dt_ms, CAST(coalesce(bit_count(xor(h, ph)), -1) AS INTEGER) AS bits, round(e[1] * pe[1] + e[2] * pe[2], 6) AS cosine FROM y WHERE ord > 0""")
def adjacent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("id")
    rows = frames(spark, sf_dir, "id", "captured_ms", "phash", "af", "tenengrad").select(
        "ord", F.when(e % 9 != 0, F.col("captured_ms")).alias("captured_ms"), F.when(e % 5 != 0, F.col("phash")).alias("phash"), F.when(e % 4 != 0, F.array("af", "tenengrad")).alias("embedding")
    )
    made = islands.adjacent_signals(rows)
    return made.select("ord", "dt_ms", "bits", F.when(~F.isnan("cosine"), F.round("cosine", 6)).alias("cosine"))


@_query("""WITH w AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_id % 6 <> 0 THEN value * 40 END AS width FROM events),
d AS (SELECT *, CASE WHEN width > 1750 THEN true WHEN width < 1650 THEN false END AS x FROM w)
SELECT key, seq, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS engaged FROM d""")
def middle_size_engaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), e.alias("seq"), F.when(e % 6 != 0, F.col("value") * 40).alias("width"))
    return ratings.engaged(rows).select("key", "seq", "engaged")


@_query("""WITH x AS (SELECT 'p' || (user_id % 700) || '/' || (event_id % 50) AS path, epoch_us(ts) // 1000 AS at_ms, 'e' || event_id AS error FROM events),
g AS (SELECT path, count(*) AS attempts, arg_max(error, (at_ms, error)) AS last_error, max(at_ms) AS last_at FROM x GROUP BY 1)
SELECT path, attempts, last_error, CASE WHEN attempts < 4 THEN last_at + least(30000, CAST(1000 * pow(2, attempts - 1) AS BIGINT)) END AS next_retry_ms, attempts >= 4 AS terminal FROM g""")
def failed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("p"), (F.col("user_id") % 700).cast("string"), F.lit("/"), (F.col("event_id") % 50).cast("string"))
    rows = table(spark, sf_dir, "events").select(path.alias("path"), expr.epoch_ms(F.col("ts")).alias("at_ms"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))
    return ratings.tier_errors(rows)


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'disabled' WHEN p_partkey % 3 = 0 THEN 'analyzing' WHEN p_size > 25 THEN 'analyzedNoSuggestions' WHEN p_partkey % 2 = 0 THEN 'notAnalyzedAutoStart' ELSE 'notAnalyzedManual' END AS state,
  p_size % 7 >= 1 AS stars, CASE p_size % 3 WHEN 0 THEN 'favorites' WHEN 1 THEN 'keeps' ELSE 'keeps' END AS next_keeps FROM part""")
def small_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    current = F.when(size % 3 == 0, "keeps").when(size % 3 == 1, "favorites").otherwise("suggested")
    state = ratings.empty_state(k % 5 != 0, k % 2 == 0, k % 3 == 0, F.greatest(size - 25, F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", state.alias("state"), ratings.has_stars(size % 7).alias("stars"), ratings.next_filter(current, "keeps").alias("next_keeps"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'network' ELSE 'local' END AS storage, CASE p_size % 4 WHEN 0 THEN 'keepsFavs' WHEN 1 THEN 'unrated' ELSE 'all' END AS filter, p_size % 2 = 0 AS smart, p_size % 5 = 0 AS exif,
  CASE WHEN p_size % 6 = 0 THEN 'in/' || p_partkey END AS pinned, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '_rejected' END AS rejected FROM part""")
def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every shape: right values, wrong kinds, older names and broken JSON."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    part = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    json = F.concat(
        F.lit('{"storageMode": '), part(size % 3 == 0, '"network"', "7"), F.lit(', "defaultFilter": '), F.when(size % 4 == 0, F.lit('"favorites"')).when(size % 4 == 1, F.lit('"unrated"')).otherwise(F.lit('"older"')),
        F.lit(', "smartCulling": '), part(size % 2 == 0, '"yes"', "false"), F.lit(', "defaultExifVisible": '), part(size % 5 == 0, "true", "null"),
        F.lit(', "exportFolder": {"mode": "pinned", "path": '), F.when(size % 6 == 0, F.concat(F.lit('"in/'), key, F.lit('"'))).otherwise(F.lit("3")), F.lit('}, "rejectedSubfolder": '), part(size % 3 == 0, '" x. "', '"CON"'), F.lit("}"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", settings.settings(json).alias("s"))
    return rows.select("p_partkey", F.col("s.storageMode").alias("storage"), F.col("s.defaultFilter").alias("filter"), F.col("s.smartCulling").alias("smart"), F.col("s.defaultExifVisible").alias("exif"), F.col("s.exportFolderPinned").alias("pinned"), F.col("s.rejectedSubfolder").alias("rejected"))


@_query("SELECT o_orderkey, bit_count(xor(o_orderkey * 2654435761, o_custkey * 40503 * 65537)) AS d FROM orders")
def hash_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c: F.lpad(F.hex(c), 16, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", expr.hamming(h(F.col("o_orderkey") * 2_654_435_761), h(F.col("o_custkey") * 40_503 * 65_537)).cast("tinyint").alias("d"))


@_query("""WITH e AS (SELECT vec_id, embedding, lag(embedding) OVER (ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(p AS DOUBLE[])), 6) AS cosine, coalesce(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(p AS DOUBLE[])) >= 0.25, false) AS linked FROM e""")
def adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.floor(F.col("vec_id") / 100_000), F.col("vec_id"))
    before = e.select((F.col("ord") + 1).alias("ord"), F.col("embedding").alias("p"))
    d = expr.dot(F.col("embedding"), F.col("p"))
    return e.join(before, "ord", "left").select("vec_id", F.round(d, 6).alias("cosine"), F.coalesce(d >= 0.25, F.lit(False)).alias("linked"))


@_query("""WITH h AS (SELECT l_returnflag, l_linestatus, least(255, greatest(0, CAST(floor(l_extendedprice * 256 / 120000) AS INTEGER))) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM h)
SELECT l_returnflag, l_linestatus, CAST(min(bin) FILTER (WHERE cum >= ceil(total / 20)) AS INTEGER) AS p5, CAST(min(bin) FILTER (WHERE cum >= total - floor(total / 20)) AS INTEGER) AS p95,
  (min(bin) FILTER (WHERE cum >= total - floor(total / 20)) - min(bin) FILTER (WHERE cum >= ceil(total / 20))) / 255.0::DOUBLE AS spread FROM c GROUP BY 1, 2""")
def histogram_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.lower_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), 256, 120_000)


@_query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem),
k AS (SELECT l_suppkey, list(v ORDER BY i) AS v FROM r WHERE i <= 16 GROUP BY 1) SELECT l_suppkey, v[(len(v) - 1) // 2 + 1] AS noise_floor FROM k""")
def noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.lowest_median(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


_PARTS = 10


def _in_parts(spark: SparkSession, sf_dir: str, part) -> DataFrame:
    """lineitem with the number of its part, of ten."""
    return table(spark, sf_dir, "lineitem").withColumn("part", part % _PARTS)


@_query(_SQL["histogram_spread"])
def histogram_spread_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from merged summaries."""
    key = ["l_returnflag", "l_linestatus"]
    parts = summaries.histogram(_in_parts(spark, sf_dir, F.col("l_orderkey")), ["part", *key], F.col("l_extendedprice"), 256, 120_000)
    return summaries.spread(summaries.merged_histograms(parts, key), key, 256)


@_query(_SQL["noise_floors"])
def noise_floors_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from merged summaries."""
    parts = summaries.lowest(_in_parts(spark, sf_dir, F.col("l_partkey")), ["part", "l_suppkey"], "l_extendedprice")
    return summaries.noise_floor(summaries.merged_lowest(parts, "l_suppkey"), "l_suppkey")


@_query("""WITH r AS (SELECT user_id AS path, event_id AS seq, event_type AS camera, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 6 AS INTEGER) END AS lrc_rating, CASE WHEN event_id % 3 = 0 THEN 'h' || event_id END AS phash FROM events)
SELECT path, arg_max(camera, seq) AS camera, arg_max(lrc_rating, seq) FILTER (WHERE lrc_rating IS NOT NULL) AS lrc_rating, arg_max(phash, seq) FILTER (WHERE phash IS NOT NULL) AS phash FROM r GROUP BY 1""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), e.alias("seq"), F.col("event_type").alias("camera"), F.when(e % 5 == 0, (e % 6).cast("int")).alias("lrc_rating"), F.when(e % 3 == 0, F.concat(F.lit("h"), e.cast("string"))).alias("phash"))
    return ratings.merged_meta(rows).select("path", "camera", "lrc_rating", "phash")


@_query("""SELECT event_id, CASE WHEN value > 0 THEN least(1.0, value / 300) * (1 - least(1.0, value / 150)) ELSE 0.0 END AS blur, least(greatest(ln(1 + value / 0.5) / 12, 0), 1) AS sharp,
  CASE WHEN event_id % 4 <> 0 THEN least(30000, CAST(1000 * pow(2, event_id % 4 - 1) AS INTEGER)) END AS wait_ms FROM events""")
def frame_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf_dir, "events")
    wait = expr.backoff_ms(F.when(e % 4 == 0, 4).otherwise(e % 4))
    return rows.select("event_id", expr.motion_blur(v / 300, F.lit(1.0), F.least(F.lit(1.0), v / 150)).alias("blur"), expr.normalised_sharpness(v, F.lit(0.5)).alias("sharp"), wait.alias("wait_ms"))
