"""Roll-ups renewed after a change against those from scratch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import rollup
from test_rollup_gate import m, nodes


def function(rnd, i):
    """One function with or without measurements, in one of three packages or none."""
    stmts = rnd.choice([None, 0, 4, 9])
    covered = None if stmts is None else rnd.randint(0, stmts)
    percent = None if not stmts else round(100.0 * covered / stmts, 1)
    killed = rnd.choice([None, 0, 3])
    rest = (None,) * 6 if killed is None else (rnd.randint(0, 2), 1, 0, rnd.choice([None, 60.0, 100.0]), rnd.random() < 0.3, 2)
    crap = None if stmts is None else rnd.choice([1.0, 2.5, 30.0, 30.0, 90.25])
    package = rnd.choice(["m/p", "m/p", "m/p", "m/q", "m/r", None])
    return (f"m/f{i:03d}", f"f{i}", package, "a.go", rnd.randint(1, 9), 1, crap, stmts, covered, percent, rnd.random() < 0.2, killed, *rest)


def rows(frames):
    return [sorted(map(repr, f.collect())) for f in frames]


def test_equals_roll_up_over_random_snapshots(spark):
    rnd = random.Random(5)
    now = {i: function(rnd, i) for i in range(60)}
    before, state = None, None
    for turn in range(10):
        after = m(spark, *now.values())
        if state is None:
            state = rollup.start_state(after)
        else:
            state = rollup.change_state(state, after, rollup.changes_between(before, after))
        assert rows(rollup.roll_up_state(state, nodes(spark))) == rows(rollup.roll_up(after, nodes(spark))), turn
        before = after
        for i in rnd.sample(range(70), 12):  # some vanish, some appear, some change or move
            if i in now and rnd.random() < 0.4:
                del now[i]
            else:
                now[i] = function(rnd, i)
        if turn == 6:  # a package loses all its functions
            now = {i: f for i, f in now.items() if f[2] != "m/q"}


def test_reads_only_what_changed(spark):
    rnd = random.Random(8)
    first = [function(rnd, i) for i in range(80)]
    before = m(spark, *first)
    last = before.where("parent = 'm/p'").agg(F.max("id")).first()[0]
    changes = spark.createDataFrame([("r", "m/p", last)], "repo string, parent string, id string")
    # values of other packages and slices that must not be seen
    where = f"parent = 'm/p' and pmod(xxhash64(id), {rollup.SLICES}) = pmod(xxhash64('{last}'), {rollup.SLICES})"
    broken = before.withColumn("crap", F.expr(f"if({where}, crap, 1e9)"))
    state = rollup.change_state(rollup.start_state(before), broken, changes)
    assert rows(rollup.roll_up_state(state, nodes(spark))) == rows(rollup.roll_up(before, nodes(spark)))


def test_changes(spark):
    rnd = random.Random(1)
    f = [function(rnd, i)[:2] + ("m/p",) + function(rnd, i)[3:] for i in range(4)]
    moved = f[1][:2] + ("m/q",) + f[1][3:]
    before, after = m(spark, f[0], f[1], f[2]), m(spark, f[0], moved, f[3])
    assert pairs(rollup.changes_between(before, after), "parent", "id") == [("m/p", "m/f001"), ("m/p", "m/f002"), ("m/p", "m/f003"), ("m/q", "m/f001")]
    assert rollup.changes_between(before, before).count() == 0


def test_nothing_at_all(spark):
    none = m(spark, function(random.Random(1), 1)).limit(0)
    state = rollup.change_state(rollup.start_state(none), none, rollup.changes_between(none, none))
    packages, modules = rollup.roll_up_state(state, nodes(spark))
    assert [r["functions"] for r in packages.collect()] == [0, 0, 0] and modules.first()["functions"] == 0
