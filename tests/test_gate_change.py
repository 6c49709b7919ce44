from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import gate, scopes
from plumbline.operators.coverage import state_runs
from plumbline.plans import check

KEY = "repo string, snapshot_id string, id string, "
FUNCTION = KEY + (
    "file string, cognitive int, crap double, percent double, coverage_stale boolean, score double, mutation_stale boolean"
)
STATE = KEY + "line int, state string"
BREACH = ["repo", "snapshot_id", "id", "name", "kind", "value", "limit", "hint"]


def world(rng, n):
    """Functions by id, with what a breach depends on, and their uncovered lines."""
    return {f"m/p.f{i}": fresh(rng) for i in range(n)}


def fresh(rng):
    maybe = lambda x: rng.choice([x, x, None])
    return (
        rng.choice(["p/a.go", "q/b.go"]),
        maybe(rng.randint(10, 20)),
        maybe(rng.choice([7.0, 8.0, 9.0])),
        maybe(rng.choice([79.0, 80.0, 100.0])),
        maybe(rng.random() < 0.3),
        maybe(rng.choice([69.0, 70.0])),
        maybe(rng.random() < 0.3),
    ), frozenset(rng.sample(range(1, 20), rng.randint(0, 6)))


def tables(spark, w, snapshot):
    key = lambda i: ("r" + str(int(i[5:]) % 2), snapshot, i)
    f = spark.createDataFrame([(*key(i), *row) for i, (row, _) in w.items()], FUNCTION)
    lines = [(*key(i), n, "uncovered") for i, (_, at) in w.items() for n in at] + [(*key(i), 30, "covered") for i in w]
    return f, spark.createDataFrame(lines, STATE)


def changed(rng, w):
    w = dict(w)
    for i in rng.sample(sorted(w), 4):
        row, at = w[i]
        w[i] = rng.choice([(row, at ^ {rng.randint(1, 19)}), fresh(rng), (fresh(rng)[0], at)])
    for i in rng.sample(sorted(w), 2):
        del w[i]
    return w | {f"m/p.f{100 + rng.randint(0, 99)}": fresh(rng)}


@pytest.mark.parametrize("seed", [1, 2])
def test_breaches_after_changes_equal_those_from_scratch(spark, seed):
    rng = random.Random(seed)
    critical = spark.createDataFrame([("r0", "p/**")], "repo string, pattern string")
    w = world(rng, 14)
    result = None
    for step in range(3):
        f, lines = tables(spark, w, f"s{step}")
        limits = spark.createDataFrame([("r1", 7.0 + step // 2, None, None, None)], "repo string, crap_max double, cognitive_max int, coverage_min double, mutation_min double")
        earlier = result["breaches"] if result else None
        result = check.check_change(result, f, lines, limits, critical)
        th = scopes.with_effective_thresholds(f, limits)
        scratch = gate.breaches(f, th, scopes.files_matching(f, critical), state_runs(lines, "uncovered"))
        assert pairs(result["breaches"], *BREACH) == pairs(scratch, *BREACH)
        was = {r[:3]: r[3] for r in pairs(earlier, "repo", "id", "kind", "value")} if earlier else {}
        now = {r[:3]: r[3] for r in pairs(scratch, "repo", "id", "kind", "value")}
        expected = sorted(
            (*k, "kept" if k in was and k in now else "appeared" if k in now else "resolved", was.get(k), now.get(k)) for k in was.keys() | now.keys()
        )
        got = sorted((tuple(r) for r in result["changes"].select("repo", "id", "kind", "change", "value_before", "value").collect()), key=lambda r: r[:3])
        assert got == expected
        w = changed(rng, w)


def test_only_changed_functions_are_looked_at_again(spark):
    w = world(random.Random(3), 8)
    f, lines = tables(spark, w, "s1")
    first = check.check_change(None, f, lines)
    marked = first["breaches"].withColumn("hint", F.lit("kept"))
    w2 = dict(w)
    one = sorted(w)[0]
    w2[one] = (("p/a.go", 40, *w[one][0][2:]), w[one][1])
    second = check.check_change({"breaches": marked, "inputs": first["inputs"]}, *tables(spark, w2, "s2"))
    hints = pairs(second["breaches"], "id", "hint")
    assert {i for i, h in hints if h != "kept"} == {one}
    assert pairs(second["breaches"].select("snapshot_id").distinct(), "snapshot_id") == [("s2",)]


def test_nothing_to_check(spark):
    f, lines = tables(spark, {"m/p.f1": (("p/a.go", 1, 1.0, 100.0, False, 100.0, False), frozenset())}, "s1")
    first = check.check_change(None, f.limit(0), lines.limit(0))
    assert first["breaches"].count() == 0 and first["changes"].count() == 0
    second = check.check_change(first, f, lines)
    assert second["breaches"].count() == 0 and second["verdict"].first()["pass"] is True
