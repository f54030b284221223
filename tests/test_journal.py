"""Undo and redo, duels and as-of joins against plain versions, and that they do not depend on blocks and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from shutterloom.operators import asof, duels, history

ACTIONS = "session long, seq long, kind string, changes array<struct<img_id:long,before:string,after:string>>"


def stack(rows, depth):
    """(session, seq, pos, img, rating) by two lists a session."""
    out, held = [], {}
    for session, seq, kind, changes in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        undo, redo = held.setdefault(session, ([], []))
        real = [c for c in changes or [] if c[1] != c[2]]
        if kind == "rate" and real:
            undo.append(real)
            del undo[:-depth]
            redo.clear()
            made = [(c[0], c[2]) for c in real]
        elif kind == "undo" and undo:
            redo.append(undo.pop())
            made = [(c[0], c[1]) for c in redo[-1]]
        elif kind == "redo" and redo:
            undo.append(redo.pop())
            made = [(c[0], c[2]) for c in undo[-1]]
        else:
            made = []
        out += [(session, seq, i, *m) for i, m in enumerate(made)]
    return sorted(out, key=repr)


def log(seed, n, sessions):
    rng, marks = random.Random(seed), [None, "keep", "reject"]
    weights = ((6, 2, 2, 0.2), (1, 8, 1, 0), (1, 3, 6, 0))  # recording, taking back, bringing again
    for i in range(n):
        kind = rng.choices(["rate", "undo", "redo", "other"], weights[i // 40 % 3])[0]
        changes = [(rng.randrange(9), rng.choice(marks), rng.choice(marks)) for _ in range(rng.choice([1, 1, 2]))]
        yield (rng.randrange(sessions) or None, i, kind, changes if i % 50 else None)


@pytest.mark.parametrize("depth, block, fan, n, sessions", [(5, 4, 3, 300, 3), (3, 2, 2, 200, 9), (100, 128, 64, 900, 1)])
def test_undo_is_that_of_a_stack(spark, monkeypatch, depth, block, fan, n, sessions):
    monkeypatch.setattr(history, "FAN", fan)
    rows = list(log(n, n, sessions))
    made = history.effects(spark.createDataFrame(rows, ACTIONS), depth, block)
    assert sorted(map(tuple, made.collect()), key=repr) == stack(rows, depth)


def test_undo_goes_a_hundred_actions_deep_and_needs_no_python(spark):
    rows = [(1, i, "rate", [(i, None, "keep")]) for i in range(130)] + [(1, 200 + i, "undo", None) for i in range(120)] + [(1, 400 + i, "redo", []) for i in range(50)]
    made = history.effects(spark.createDataFrame(rows, ACTIONS).repartition(3))
    got = history.ratings_after(made)
    assert {r.img_id for r in got.collect()} == {*range(80)}  # 30 are out of reach, 100 come back off, 50 on again
    assert "Python" not in got._jdf.queryExecution().toString() and "InPandas" not in got._jdf.queryExecution().toString()
    assert history.effects(spark.createDataFrame([], ACTIONS)).count() == 0


def nearest(row, others, direction, exact, tolerance):
    k, t = row
    if k is None or t is None:
        return None
    back = [o for o in others if o[0] == k and o[1] is not None and (o[1] <= t if exact else o[1] < t)]
    ahead = [o for o in others if o[0] == k and o[1] is not None and (o[1] >= t if exact else o[1] > t)]
    b = max(back, key=lambda o: (o[1], o[2]), default=None) if direction != "forward" else None
    a = min(ahead, key=lambda o: (o[1], o[2]), default=None) if direction != "backward" else None
    b, a = (x if x and (tolerance is None or abs(x[1] - t) <= tolerance) else None for x in (b, a))
    if b and a:
        return b[2] if t - b[1] <= a[1] - t else a[2]
    return (b or a or (0, 0, None))[2]


@pytest.mark.parametrize("direction, exact", [("backward", True), ("backward", False), ("forward", True), ("forward", False), ("nearest", True)])
@pytest.mark.parametrize("span, tolerance", [(3, None), (1000, 4)])
def test_asof_against_all_pairs(spark, direction, exact, span, tolerance):
    rng = random.Random(span)
    place = lambda: rng.choice([None, *range(60)])
    left = [(i, rng.choice([None, "a", "a", "a", "b", "c"]), place()) for i in range(120)]
    right = [(rng.choice([None, "a", "a", "b", "d"]), place(), i) for i in range(40)] + [("a", 7, 100 + i) for i in range(30)]
    a = spark.createDataFrame(left, "id long, k string, `t.x` long").withColumn("_t", F.lit(3)).withColumn("ord", F.col("id"))
    b = spark.createDataFrame(right, "k string, at long, name long").repartition(3)
    made = asof.asof(a, b, ("t.x", "at"), ("k",), direction, exact, None if tolerance is None else F.lit(tolerance), ("name",), span)
    assert made.columns == ["id", "k", "t.x", "_t", "ord", "match"]
    assert {(r.id, r.ord, r.match and r.match.name) for r in made.collect()} == {(i, i, nearest((k, t), right, direction, exact, tolerance)) for i, k, t in left}


def test_a_task_carries_values_along_few_ranges_however_many_there_are(spark):
    rows = spark.range(4000).select(F.col("id").alias("ord"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("x"))
    made = asof.carried(rows, F.col("x"), True, True, span=100).withColumn("_task", F.spark_partition_id())
    got = made.collect()
    assert [(r._back, r._ahead) for r in sorted(got, key=lambda r: r.ord)] == [(None if i == 0 else (i - 1) // 7 * 7, None if i >= 3997 else i // 7 * 7 + 7) for i in range(4000)]
    assert made.rdd.getNumPartitions() == 40 and len({r._task for r in got}) > 15  # 4 is the number of shuffle partitions


def test_asof_of_empty_tables_and_wrong_directions(spark):
    a = spark.createDataFrame([(1, 5)], "id long, t long")
    assert [tuple(r) for r in asof.asof(a, a.limit(0), "t").collect()] == [(1, 5, None)]
    assert asof.asof(a.limit(0), a, "t").count() == 0
    for wrong in ({"direction": "up"}, {"exact": False}):
        with pytest.raises(ValueError):
            asof.asof(a, a, "t", **wrong)


def play(frames, champion, challenger, verbs):
    """(seq, champion, challenger, changes, next champion, next challenger) by a walk along the frames."""
    rating, order, out = {i: r for i, _, r in frames}, {i: o for i, o, _ in frames}, []
    for seq, verb in verbs:
        if challenger is None or verb not in duels.VERBS:
            continue
        old, new = duels.VERBS[verb]
        changes = [(champion, rating[champion], old)] if old and champion is not None else []
        changes.append((challenger, rating[challenger], new))
        rating |= {i: after for i, _, after in changes}
        crowned = challenger if verb == "win" else champion
        free = [i for i in order if rating[i] is None and i != crowned]
        ahead = min((i for i in free if order[i] > order[challenger]), key=order.get, default=None)
        behind = max((i for i in free if order[i] < order[challenger]), key=order.get, default=None)
        after = behind if ahead is None else ahead
        out.append((seq, champion, challenger, changes, crowned, after))
        champion, challenger = crowned, after
    return out


def test_duels_are_those_of_a_walk(spark):
    rng = random.Random(6)
    frames, opened, verbs, want = [], [], [], set()
    for session in range(12):
        own = [(100 * session + i, o, rng.choice([None, None, None, "keep"])) for i, o in enumerate(rng.sample(range(50), 9))]
        champion, challenger = rng.sample([i for i, _, _ in own], 2)
        said = [(i, rng.choice([*duels.VERBS, None, "look"])) for i in range(14)]
        frames += [(session, *f) for f in own]
        verbs += [(session, *v) for v in said]
        if session < 10:
            opened.append((session, champion if session % 4 else None, challenger if session != 9 else None))
            if session != 9:
                want |= {(session, s, a, b, tuple(c), d, e) for s, a, b, c, d, e in play(own, opened[-1][1], challenger, said)}
    got = duels.duelled(
        spark.createDataFrame(frames, "session long, id long, ord long, rating string"), spark.createDataFrame(opened, "session long, champion long, challenger long"), spark.createDataFrame(verbs, "session long, seq long, verb string")
    )
    assert {(r.session, r.seq, r.champion, r.challenger, tuple(tuple(c) for c in r.changes), r.next_champion, r.next_challenger) for r in got.collect()} == want
    assert duels.duelled(spark.createDataFrame(frames, "session long, id long, ord long, rating string"), spark.createDataFrame([], "session long, champion long, challenger long"), spark.createDataFrame(verbs, "session long, seq long, verb string")).count() == 0
