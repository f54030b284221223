"""Undo and redo of recorded actions, without a task that holds a session.

What undo and redo do depends on two numbers only: how many actions can be taken back (``u``) and how many can be taken
back or brought again (``s``). Their sum is at most the depth of the stack, so what a stretch of actions does to any
two such numbers fits in a bounded summary:

* until its first recorded action, undo and redo move u between 0 and s: u becomes max(lo, min(hi, u + a)), where
  lo and hi, for each s, are where the ends 0 and s get to;
* after it nothing can be redone, so all depends on u alone: a row for each u gives the new u, s and height.

Summaries of neighbouring stretches compose, and composing is associative. So blocks of the log are summed up in
parallel, the summaries are composed by groups of groups, and the numbers at the beginning of each block come back
down. The height counts actions on the stack without regard to its depth: an undo at a height concerns the last
action that was put there, which is an as-of lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import carried
from .columns import let
from .ordering import ordered, settled

#: Fixed value: actions that can be taken back.
UNDO_DEPTH = 100
#: Actions in a block, and summaries that are composed in one row.
BLOCK, FAN = 128, 64
_NO_PAIRS, _NO_TRIPLES = "array<struct<lo:int,hi:int>>", "array<struct<u:int,s:int,h:int>>"
_STATE = "struct<session:{0},u:int,s:int,h:bigint>"


def _int(c: Column) -> Column:
    return c.cast("int")


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _nothing(depth: int) -> Column:
    """The summary of no actions."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda s: _struct(lo=F.lit(0), hi=s))
    return _struct(a=F.lit(0), pre=ends.cast(_NO_PAIRS), rated=F.lit(False), top=F.array().cast(_NO_TRIPLES))


def _then(f: Column, kind: Column, n: Column, depth: int) -> Column:
    """The summary f with n more actions of a kind: rate, undo or redo."""
    plain = ~f["rated"]
    u, d = kind == "undo", kind == "redo"

    def ends(x: Column, s: Column) -> Column:
        step = lambda v: _int(F.when(u, F.greatest(F.lit(0), v - n)).when(d, F.least(s, v + n)).otherwise(v))
        return _struct(lo=step(x["lo"]), hi=step(x["hi"]))

    def tops(x: Column) -> Column:
        moved = _int(F.when(u, F.greatest(F.lit(0), x["u"] - n)).when(d, F.least(x["s"], x["u"] + n)).otherwise(F.least(F.lit(depth), x["u"] + n)))
        rate = kind == "rate"
        return let(moved, lambda v: _struct(u=v, s=F.when(rate, v).otherwise(x["s"]), h=_int(x["h"] + F.when(rate, n).otherwise(v - x["u"]))))

    first = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda v: let(_int(F.least(F.lit(depth), v + n)), lambda m: _struct(u=m, s=m, h=n)))
    return _struct(
        a=_int(f["a"] + F.when(plain & u, -n).when(plain & d, n).otherwise(0)), pre=F.when(plain & (kind != "rate"), F.transform(f["pre"], ends)).otherwise(f["pre"]),
        rated=f["rated"] | (kind == "rate"), top=F.when(f["rated"], F.transform(f["top"], tops)).when(kind == "rate", first).otherwise(f["top"]),
    )


def _alike(events: Column) -> Column:
    """Neighbouring actions of one kind as one: (kind, n)."""

    def step(runs: Column, e: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(_struct(kind=last["kind"], n=last["n"] + 1)))
        return F.when((F.size(runs) > 0) & (last["kind"] == e["kind"]), longer).otherwise(F.concat(runs, F.array(_struct(kind=e["kind"], n=F.lit(1)))))

    return F.aggregate(events, F.array().cast("array<struct<kind:string,n:int>>"), step)


def _moved(f: Column, u: Column, s: Column) -> Column:
    """Where u is after the actions of f before its first recorded one."""
    return let(F.get(f["pre"], s), lambda x: _int(F.greatest(x["lo"], F.least(x["hi"], u + f["a"]))))


def _applied(f: Column, x: Column) -> Column:
    """The state x (u, s, h) after the stretch f."""

    def after(v: Column) -> Column:
        t = F.get(f["top"], v)
        return F.when(f["rated"], _struct(u=t["u"], s=t["s"], h=x["h"] + v - x["u"] + t["h"])).otherwise(_struct(u=v, s=x["s"], h=x["h"] + v - x["u"]))

    return let(_moved(f, x["u"], x["s"]), after)


def _composed(f: Column, g: Column) -> Column:
    """f, then g."""
    ends = F.transform(f["pre"], lambda x, s: _struct(lo=_moved(g, x["lo"], s), hi=_moved(g, x["hi"], s)))
    tops = F.transform(f["top"], lambda x: let(_applied(g, x), lambda y: _struct(u=y["u"], s=y["s"], h=_int(y["h"]))))
    return F.when(f["rated"], _struct(a=f["a"], pre=f["pre"], rated=F.lit(True), top=tops)).otherwise(_struct(a=_int(f["a"] + g["a"]), pre=ends, rated=g["rated"], top=g["top"]))


def _start(session: Column) -> Column:
    """The state of a session before its first action."""
    return _struct(session=session, u=F.lit(0), s=F.lit(0), h=F.lit(0).cast("long"))


def _with_session(x: Column, session: Column) -> Column:
    return _struct(session=session, u=x["u"], s=x["s"], h=x["h"])


def _joined(f: Column, g: Column) -> Column:
    """Two neighbouring blocks as one. A block is (lead, f, whole, last): its first session with the summary of that
    session's stretch, whether that is all, and if not the state of its last session at the end."""
    same = f["last"]["session"].eqNullSafe(g["lead"])
    into = F.when(same, f["last"]).otherwise(_start(g["lead"]))
    end = F.when(g["whole"], _with_session(_applied(g["f"], into), g["lead"])).otherwise(g["last"])
    one = f["whole"] & same
    return _struct(lead=f["lead"], f=F.when(one, _composed(f["f"], g["f"])).otherwise(f["f"]), whole=one & g["whole"], last=end)


def _next(x: Column, block: Column) -> Column:
    """The state after a block, from the one before it."""
    into = F.when(x["session"].eqNullSafe(block["lead"]), x).otherwise(_start(block["lead"]))
    return F.when(block["whole"], _with_session(_applied(block["f"], into), block["lead"])).otherwise(block["last"])


def _begun(blocks: DataFrame, kind: str) -> DataFrame:
    """_b, begin: the state at the beginning of each block (_b, dense, and sum), by groups of FAN and groups of groups."""
    state = _STATE.format(kind)
    groups = blocks.groupBy(F.floor(F.col("_b") / FAN).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_b", "sum"))).alias("_all"))
    many = blocks.agg(F.max("_b").alias("n")).first().n
    if many is not None and many >= FAN:
        first = F.col("_all")[0]["sum"]
        up = settled(groups.select(F.col("_g").alias("_b"), F.aggregate(F.slice("_all", 2, FAN), first, lambda f, x: _joined(f, x["sum"])).alias("sum")))
        groups = groups.join(_begun(up, kind).select(F.col("_b").alias("_of"), "begin"), F.col("_g") == F.col("_of"))
    else:
        groups = groups.withColumn("begin", _start(F.lit(None).cast(kind)).cast(state))
    zero = _struct(x=F.col("begin"), out=F.array().cast(f"array<struct<_b:bigint,begin:{state}>>"))

    def step(acc: Column, member: Column) -> Column:
        return _struct(x=_next(acc["x"], member["sum"]), out=F.concat(acc["out"], F.array(F.struct(member["_b"].alias("_b"), acc["x"].alias("begin")))))

    return groups.select(F.explode(F.aggregate("_all", zero, step)["out"]).alias("_o")).select("_o._b", "_o.begin")


def recorded(actions: DataFrame) -> DataFrame:
    """actions without changes of nothing, and without recorded actions that have no change left."""
    changes = F.filter(F.coalesce("changes", F.array().cast(actions.schema["changes"].dataType)), lambda c: ~c["before"].eqNullSafe(c["after"]))
    return actions.withColumn("changes", changes).where((F.col("kind") != "rate") | (F.size("changes") > 0))


def effects(actions: DataFrame, depth: int = UNDO_DEPTH, block: int = BLOCK) -> DataFrame:
    """session, seq, pos, img_id, rating: every change that the actions of each session make, in the order of seq, then pos.

    ``actions`` has session, seq, kind and changes, an array of (img_id, before, after). rate records its changes
    and forgets what could be redone; undo takes the last action not taken back, of ``depth`` at most, and sets the
    ratings before it; redo brings it again. An action's changes go together. Changes of nothing, and actions without
    others, are not recorded; nothing to undo or redo changes nothing. A null session is one too; rows of another kind,
    or of none, count for nothing; rows that tie in (session, seq) go in an arbitrary order. An empty log has no effects.
    """
    kind = actions.schema["session"].dataType.simpleString()
    rows = recorded(actions.where(F.col("kind").isin("rate", "undo", "redo"))).select("session", "seq", "kind", "changes")
    rows = ordered(rows, F.col("session"), F.col("seq"), F.monotonically_increasing_id())
    events = F.array_sort(F.collect_list(F.struct("ord", "session", "kind")))
    # a small log is little to send and much to work out, so that its blocks are dealt out to as many tasks as there may be
    tasks = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.select(F.floor(F.col("ord") / block).alias("_b"), "ord", "session", "kind").repartition(tasks, "_b").groupBy("_b").agg(events.alias("_e"))
    lead = F.col("_e")[0]["session"]
    own = F.filter("_e", lambda e: e["session"].eqNullSafe(lead))
    last = F.element_at("_e", -1)["session"]
    tail = F.filter("_e", lambda e: e["session"].eqNullSafe(last))
    whole = last.eqNullSafe(lead)
    fold = lambda es: F.aggregate(_alike(es), _nothing(depth), lambda f, e: _then(f, e["kind"], e["n"], depth))
    ended = F.aggregate(_alike(tail), _start(last), lambda x, e: _stepped(x, e["kind"], e["n"], depth))
    summed = blocks.select("_b", _struct(lead=lead, f=fold(own), whole=whole, last=F.when(whole, _start(last)).otherwise(ended)).alias("sum"))
    begun = _begun(settled(summed), kind)
    walked = blocks.join(begun.withColumnRenamed("_b", "_of").repartition(tasks, "_of"), F.col("_b") == F.col("_of"))
    made = "array<struct<ord:bigint,session:{0},kind:string,slot:bigint>>".format(kind)

    def step(acc: Column, e: Column) -> Column:
        into = F.when(acc["x"]["session"].eqNullSafe(e["session"]), acc["x"]).otherwise(_start(e["session"]))

        def move(x: Column, y: Column) -> Column:
            # an undo concerns the height it leaves, the others that which they reach
            slot = F.when(e["kind"] == "undo", x["h"]).otherwise(y["h"])
            one = F.array(_struct(ord=e["ord"].cast("long"), session=e["session"], kind=e["kind"], slot=slot)).cast(made)
            return _struct(x=y, out=F.when(x["h"] != y["h"], F.concat(acc["out"], one)).otherwise(acc["out"]))

        return let(into, lambda x: let(_stepped(x, e["kind"], F.lit(1), depth), lambda y: move(x, y)))

    start = _struct(x=F.col("begin"), out=F.array().cast(made))
    steps = walked.select(F.explode(F.aggregate("_e", start, step)["out"]).alias("_s")).select(F.col("_s.session").alias("session"), F.col("_s.slot").alias("slot"), F.col("_s.ord").alias("at"), F.col("_s.kind").alias("kind"))
    # the last action recorded at the height: known to the next undo or redo there, however far it is
    steps = ordered(steps, F.col("session"), F.col("slot"), F.col("at"), name="ord")
    given = F.when(F.col("kind") == "rate", F.col("at"))
    steps = carried(steps, given, True, False).select("at", F.col("kind").alias("_kind"), F.coalesce(given, "_back").alias("of"))
    found = steps.join(rows.select(F.col("ord").alias("of"), "changes"), "of").select("at", "_kind", F.posexplode("changes").alias("pos", "c"))
    found = found.join(rows.select(F.col("ord").alias("at"), "session", "seq"), "at")
    return found.select("session", "seq", "pos", F.col("c.img_id").alias("img_id"), F.when(F.col("_kind") == "undo", F.col("c.before")).otherwise(F.col("c.after")).alias("rating"))


def _stepped(x: Column, kind: Column, n: Column, depth: int) -> Column:
    """The state after n actions of a kind."""
    rate = kind == "rate"
    moved = _int(F.when(kind == "undo", F.greatest(F.lit(0), x["u"] - n)).when(kind == "redo", F.least(x["s"], x["u"] + n)).otherwise(F.least(F.lit(depth), x["u"] + n)))
    return let(moved, lambda v: _struct(session=x["session"], u=v, s=F.when(rate, v).otherwise(x["s"]), h=x["h"] + F.when(rate, n).otherwise(v - x["u"])))


def ratings_after(made: DataFrame) -> DataFrame:
    """session, img_id, rating after all effects(); images without a rating are left out."""
    last = F.max_by("rating", F.struct("seq", "pos")).alias("rating")
    return made.groupBy("session", "img_id").agg(last).where("rating is not null")
