"""Queries over logs of actions: undo and redo, duels, and what is nearest in another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import epoch_ms
from ..operators import asof, duels, history
from .frames import FRAMES_SQL, frames, table
from .registry import query


def _rating(n: Column) -> Column:
    return F.when(n % 4 == 0, "keep").when(n % 4 == 1, "reject").when(n % 4 == 2, "favorite")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of eight sessions with long stretches of recording, taking back and bringing again."""
    e = F.col("event_id")
    phase = F.floor(e / 1250) % 4
    kind = F.when(phase == 2, F.when(e % 9 == 0, "redo").otherwise("undo")).when(e % 5 == 3, "undo").when(e % 7 == 4, "redo").otherwise("rate")
    change = lambda img, n: F.struct(img.alias("img_id"), _rating(n).alias("before"), _rating(F.floor(n / 3)).alias("after"))
    one, both = F.array(change(e % 40, e)), F.array(change(e % 40, e), change(e % 23 + 40, e + 1))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("session"), e.alias("seq"), kind.alias("kind"), F.when(e % 11 == 0, both).otherwise(one).alias("changes"))


_R = "CASE ({0}) % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 2 THEN 'favorite' END"
#: CTE x: the changes of every action that has an effect, by a stack for each session.
_REPLAY = f"""
l AS (SELECT user_id % 8 AS session, event_id AS seq,
  CASE WHEN event_id // 1250 % 4 = 2 THEN CASE WHEN event_id % 9 = 0 THEN 'redo' ELSE 'undo' END WHEN event_id % 5 = 3 THEN 'undo' WHEN event_id % 7 = 4 THEN 'redo' ELSE 'rate' END AS kind,
  list_filter([{{'img': event_id % 40, 'b': {_R.format('event_id')}, 'a': {_R.format('event_id // 3')}}}] || CASE WHEN event_id % 11 = 0 THEN [{{'img': event_id % 23 + 40, 'b': {_R.format('event_id + 1')}, 'a': {_R.format('(event_id + 1) // 3')}}}] ELSE [] END,
    lambda c: c.b IS DISTINCT FROM c.a) AS changes FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM l WHERE kind <> 'rate' OR len(changes) > 0),
u(session, i, undo, redo, kind, acting, of) AS (
  SELECT DISTINCT session, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM l
  UNION ALL
  SELECT u.session, e.i,
    CASE e.kind WHEN 'rate' THEN list_slice(undo || [seq], greatest(1, len(undo) - 98), len(undo) + 1) WHEN 'undo' THEN undo[:-2] ELSE CASE WHEN len(redo) > 0 THEN undo || [redo[-1]] ELSE undo END END,
    CASE e.kind WHEN 'rate' THEN [] WHEN 'undo' THEN CASE WHEN len(undo) > 0 THEN redo || [undo[-1]] ELSE redo END ELSE redo[:-2] END,
    e.kind, seq, CASE e.kind WHEN 'rate' THEN seq WHEN 'undo' THEN undo[-1] ELSE redo[-1] END
  FROM u JOIN e ON e.session = u.session AND e.i = u.i + 1),
x AS (SELECT session, acting AS seq, pos - 1 AS pos, c.img AS img_id, CASE WHEN kind = 'undo' THEN c.b ELSE c.a END AS rating
  FROM (SELECT u.session, u.acting, u.kind, unnest(l.changes) AS c, unnest(range(1, len(l.changes) + 1)) AS pos FROM u JOIN l ON l.session = u.session AND l.seq = u.of))
"""


@query(f"WITH RECURSIVE {_REPLAY}, z AS (SELECT session, img_id, arg_max({{'r': rating}}, (seq, pos)).r AS rating FROM x GROUP BY ALL) SELECT * FROM z WHERE rating IS NOT NULL")
def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ratings_after(history.effects(actions(spark, sf_dir)))


@query(f"WITH RECURSIVE {_REPLAY} SELECT session, seq, CAST(pos AS INTEGER) AS pos, img_id, rating FROM x")
def undo_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change that each action makes."""
    return history.effects(actions(spark, sf_dir))


def _duels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A session for each user: its frames, the first pair in view, and verbs, more than there are unrated frames."""
    e = F.col("event_id")
    shown = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), e.alias("id"), e.alias("ord"), F.when(e % 3 == 0, "keep").alias("rating"))
    middle = shown.groupBy("session").agg(F.min("id").alias("champion"), F.floor(F.avg("id")).alias("_m"))
    opened = shown.join(middle, "session").where("rating is null and id >= _m and id <> champion").groupBy("session", "champion").agg(F.min("id").alias("challenger"))
    verbs = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), e.alias("seq"), F.element_at(F.array(*[F.lit(v) for v in (*duels.VERBS, "look")]), (e % 5 + 1).cast("int")).alias("verb"))
    return shown, opened, verbs


@query("""WITH RECURSIVE s AS (SELECT user_id AS session, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'keep' END AS rating FROM events),
m AS (SELECT session, min(id) AS champion, floor(avg(id)) AS mid FROM s GROUP BY 1),
o AS (SELECT session, champion, min(id) AS challenger FROM s JOIN m USING (session) WHERE rating IS NULL AND id >= mid AND id <> champion GROUP BY 1, 2),
l AS (SELECT session, champion, challenger, list(id) FILTER (WHERE rating IS NULL AND id <> champion AND id <> challenger) AS free, max(rating) FILTER (WHERE id = champion) AS own FROM o JOIN s USING (session) GROUP BY 1, 2, 3),
v AS (SELECT user_id AS session, event_id AS seq, ['win', 'lose', 'keep_both', 'favorite_both'][event_id % 5 + 1] AS verb, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id % 5 < 4),
r(session, k, seq, verb, judged, champion, was, challenger, next_champion, next_was, next_challenger, free) AS (
  SELECT session, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, champion, own, challenger, coalesce(free, []) FROM l
  UNION ALL
  SELECT * EXCLUDE (free), list_filter(free, lambda x: x <> coalesce(next_challenger, -1)) FROM (
    SELECT r.session, v.k, v.seq, v.verb, r.next_challenger AS judged, r.next_champion AS champion, r.next_was AS was, r.next_challenger AS challenger,
      CASE WHEN v.verb = 'win' THEN r.next_challenger ELSE r.next_champion END AS next_champion, CASE WHEN v.verb = 'win' THEN 'keep' ELSE r.next_was END AS next_was,
      coalesce(list_min(list_filter(r.free, lambda x: x > r.next_challenger)), list_max(list_filter(r.free, lambda x: x < r.next_challenger))) AS next_challenger, r.free
    FROM r JOIN v ON v.session = r.session AND v.k = r.k + 1 WHERE r.next_challenger IS NOT NULL) AS q(session, k, seq, verb, judged, champion, was, challenger, next_champion, next_was, next_challenger, free))
SELECT session, seq, champion, challenger, next_champion, next_challenger,
  CASE WHEN verb = 'win' THEN champion || ':' || coalesce(was, '-') || ':reject;' ELSE '' END || challenger || ':-:' || CASE verb WHEN 'win' THEN 'keep' WHEN 'lose' THEN 'reject' WHEN 'keep_both' THEN 'keep' ELSE 'favorite' END AS changes
FROM r WHERE k > 0""")
def duel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences of duels: what each verb changes, and the pair that comes next."""
    made = duels.duelled(*_duels(spark, sf_dir))
    shown = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["img_id"], F.coalesce(c["before"], F.lit("-")), c["after"])), ";")
    return made.select("session", "seq", "champion", "challenger", "next_champion", "next_challenger", shown.alias("changes"))


#: Minutes of the month of events, and days of the orders' years stretched to as many.
_MINUTES = "CAST(floor((epoch_us(ts) // 1000 - 1704067200000) / 60000) AS BIGINT)"


@query(f"""WITH e AS (SELECT event_id, user_id % 5 AS k, {_MINUTES} AS t FROM events),
o AS (SELECT o_custkey % 5 AS k, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 18 AS t, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1, 2),
b AS (SELECT e.*, o.t AS bt, o.hi AS bk FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.t >= o.t),
a AS (SELECT b.*, o.t AS at_, o.lo AS ak FROM b ASOF LEFT JOIN o ON b.k = o.k AND b.t <= o.t)
SELECT event_id, bk AS before_key, ak AS after_key, CASE WHEN at_ IS NULL OR (bt IS NOT NULL AND t - bt <= at_ - t) THEN bk ELSE ak END AS nearest_key FROM a""")
def nearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of an event's group before, after and nearest to it in time; of two as near the earlier."""
    minute = F.floor((epoch_ms(F.col("ts")) - 1_704_067_200_000) / 60_000)
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("k"), minute.alias("t"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("k"), (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) * 18).cast("long").alias("t"), "o_orderkey")
    for direction, name in (("backward", "before_key"), ("forward", "after_key"), ("nearest", "nearest_key")):
        events = asof.asof(events, orders, "t", ("k",), direction, ties=("o_orderkey",)).withColumn(name, F.col("match.o_orderkey")).drop("match")
    return events.select("event_id", "before_key", "after_key", "nearest_key")


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT ord AS at_ FROM f WHERE rating = 'favorite' AND id % 7 = 0),
n1 AS (SELECT id, ord, at_ AS lo FROM f ASOF LEFT JOIN v ON ord >= at_), n2 AS (SELECT n1.*, at_ AS hi FROM n1 ASOF LEFT JOIN v ON ord <= at_)
SELECT id, CASE WHEN hi IS NULL OR (lo IS NOT NULL AND ord - lo <= hi - ord) THEN lo ELSE hi END AS snapped FROM n2""")
def snapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible frame that each frame snaps to, for all frames at once; of two as near the earlier."""
    rows = frames(spark, sf_dir, "id", "rating")
    made = asof.asof(rows.select("id", "ord"), rows.where("rating = 'favorite' and id % 7 = 0").select("ord"), "ord")
    return made.select("id", F.col("match.ord").alias("snapped"))
