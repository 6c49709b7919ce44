from __future__ import annotations

from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import gate, metrics, ranking, rollup, scopes
from plumbline.plans import check

KEY = "repo string, snapshot_id string, "
NODE = KEY + "id string, kind string, name string, parent string, dir string, file string, line int, end_line int"
METRIC = (
    KEY
    + "id string, name string, parent string, file string, cc int, cognitive int, crap double, stmts long, covered long, percent double, coverage_stale boolean,"
    + "killed long, survived long, not_covered long, timed_out long, score double, mutation_stale boolean, testable long"
)


def m(spark, *rows):
    return metrics.grade_columns(spark.createDataFrame([("r", "s", *x) for x in rows], METRIC))


NONE = (None,) * 7


def sample(spark):
    return m(
        spark,
        ("m/p.a", "a", "m/p", "p/a.go", 5, 3, 30.0, 6, 0, 0.0, False, *NONE),
        ("m/p.b", "b", "m/p", "p/a.go", 11, 20, 14.08, 17, 12, 70.6, True, 7, 4, 2, 0, 63.6, False, 2),
        ("m/p.c", "c", "m/p", "p/b.go", 2, 1, None, None, None, None, None, *NONE),
        ("m/p.t", "t", "m/p", "p/b.go", 1, 0, 1.0, 0, 0, None, False, 0, 0, 0, 0, None, False, 0),
        ("m/q.e", "e", "m/q", "q/e.go", 30, 15, 30.0, 4, 4, 100.0, False, 0, 0, 3, 0, None, False, 3),
    )


def nodes(spark):
    rows = [("m", "module", "m", None, None), ("m/p", "package", "p", "m", "p"), ("m/q", "package", "q", "m", "q"), ("m/r", "package", "r", "m", "r")]
    return spark.createDataFrame([("r", "s", *x, None, None, None) for x in rows], NODE)


def test_roll_up(spark):
    errors = spark.createDataFrame([("r", "m/q", "tests failed")], "repo string, package string, error string")
    churn = spark.createDataFrame([("r", "p", 9)], "repo string, dir string, churn long")
    p, mod = rollup.roll_up(sample(spark), nodes(spark), churn, errors)
    got = pairs(p, "package", "crap_max", "crap_avg", "worst", "percent", "score", "functions", "churn", "coverage_error")
    assert got == [
        ("m/p", 30.0, 15.0, "m/p.a", 52.2, 63.6, 4, 9, None),
        ("m/q", 30.0, 30.0, "m/q.e", 100.0, None, 1, 0, "tests failed"),
        ("m/r", None, None, None, None, None, 0, 0, None),
    ]
    assert pairs(p, "package", "grade_crap", "grade_mutation", "coverage_stale") == [("m/p", 1, 1, True), ("m/q", 2, 1, False), ("m/r", None, None, None)]
    # Same CRAP in both packages: the lower combined grade, then the first id.
    assert pairs(mod, "module", "worst", "percent", "functions") == [("m", "m/p.a", 59.3, 5)]


def test_worst_ties(spark):
    rows = [("m/p.z", "z", "m/p", "f", 1, 1, None, None, None, None, None, *NONE), ("m/p.y", "y", "m/p", "f", 1, 1, None, None, None, None, None, *NONE)]
    p, _ = rollup.roll_up(m(spark, *rows), nodes(spark))
    assert p.where("package = 'm/p'").first()["worst"] == "m/p.y"


def test_rank(spark):
    s = sample(spark)
    assert pairs(ranking.rank_worst(s, "crap", 2), "position", "id", "value", "stale") == [(1, "m/p.a", 30.0, False), (2, "m/q.e", 30.0, False)]
    assert pairs(ranking.rank_worst(s, "coverage", 1), "id", "value") == [("m/p.a", 0.0)]
    assert ranking.not_measured(s, "mutation").first()["not_measured"] == 4
    assert [r["id"] for r in ranking.rank_worst(s, "cc", 0).collect()] == ["m/q.e", "m/p.b", "m/p.a", "m/p.c", "m/p.t"]
    own = ranking.registry() | {"size": ranking.Metric(F.col("stmts").cast("double"), F.lit(False))}
    assert ranking.rank_worst(s, "size", 1, metrics=own).first()["id"] == "m/p.b"


def test_orders_and_reasons(spark):
    s = sample(spark)
    assert [r["id"] for r in ranking.by_risk(s).collect()] == ["m/p.a", "m/q.e", "m/p.b", "m/p.t", "m/p.c"]
    assert pairs(ranking.map_order(s, 2).where("parent = 'm/p'"), "position", "id", "more") == [(1, "m/p.c", 2), (2, "m/p.a", 2)]
    got = pairs(ranking.riskiest(s, 3).where("parent = 'm/p'"), "id", "reason", "grade")
    assert got == [("m/p.a", "no tests run it", 2), ("m/p.b", "4 mutants survived", 4), ("m/p.c", "coverage not measured", 1)]


def test_problems_and_chips(spark):
    s, th = sample(spark), scopes.with_effective_thresholds(sample(spark), None)
    errors = spark.createDataFrame([("r", "m/q", "x")], "repo string, package string, error string")
    p, _ = rollup.roll_up(s, nodes(spark), coverage_errors=errors, mutation_errors=errors)
    got = pairs(ranking.package_problems(p, s, th), "package", "ord", "text")
    assert got == [
        ("m/p", 0, "a has no tests"),
        ("m/p", 1, "4 mutants survived"),
        ("m/q", 0, "tests failed: coverage not measured"),
        ("m/q", 1, "tests fail: mutation not run"),
    ]
    chips = pairs(ranking.function_chips(s, th), "id", "ord", "text", "tone")
    assert chips == [
        ("m/p.a", 0, "untested", "red"),
        ("m/p.a", 1, "CRAP 30.0", "grade:2"),
        ("m/p.b", 0, "CRAP 14.1", "grade:4"),
        ("m/p.b", 1, "4 survived", "red"),
        ("m/q.e", 0, "CRAP 30.0", "grade:2"),
    ]


def test_gate(spark):
    s = sample(spark)
    states = spark.createDataFrame([("r", "s", "m/p.b", n, "uncovered") for n in [25, 37, 41, 42, 43]], KEY + "id string, line int, state string")
    mutants = spark.createDataFrame([("r", "s", "m/p.b", 20 + n, 1, "X", "LIVED", f"d{n}") for n in range(7)], KEY + "id string, line int, col int, type string, status string, description string")
    critical = spark.createDataFrame([("r", "q/**")], "repo string, pattern string")
    errors = spark.createDataFrame([("r", "m/p", "tests failed")], "repo string, package string, error string")
    t = check.check(s, mutants, states, critical_paths=critical, coverage_errors=errors)
    assert pairs(t["breaches"], "id", "kind", "value", "limit") == [
        ("m/p.a", "coverage", 0.0, 80.0),
        ("m/p.a", "crap", 30.0, 8.0),
        ("m/p.b", "cognitive", 20.0, 15.0),
        ("m/p.b", "coverage", 70.6, 80.0),
        ("m/p.b", "crap", 14.08, 8.0),
        ("m/p.b", "mutation", 63.6, 70.0),
        ("m/q.e", "crap", 30.0, 8.0),
    ]
    hint = t["breaches"].where("id = 'm/p.b' AND kind = 'coverage'").first()["hint"]
    assert hint == "add tests for lines a.go:25, 37, 41–43"
    assert pairs(t["details"], "position", "detail") == [(i + 1, f"a.go:{20 + i} d{i}") for i in range(5)]
    missing = pairs(t["not_measured"], "id", "metric", "reason")
    assert ("m/p.c", "crap", "coverage not measured: tests failed") in missing
    assert ("m/q.e", "mutation", "no mutant could run: 3 not covered by tests") in missing
    assert not [x for x in missing if x[0] == "m/p.t"]
    assert pairs(t["summary"], "metric", "functions") == [("crap", 1), ("mutation", 3)]
    assert t["verdict"].first()["pass"] is False
    fast = check.check(s, mutants, states, fast=True)
    assert pairs(fast["breaches"], "id", "kind") == [("m/p.a", "crap"), ("m/p.b", "cognitive"), ("m/q.e", "crap")]
    assert ("m/p.b", "crap") in pairs(fast["not_measured"], "id", "metric")
    clean = check.check(s, mutants, states, scope=s.where("name = 't'"))
    assert clean["verdict"].first()["pass"] is True


def test_limits_are_strict(spark):
    s = m(spark, ("m/p.x", "x", "m/p", "f", 8, 15, 8.0, 10, 8, 80.0, False, 7, 3, 0, 0, 70.0, False, 0))
    th = scopes.with_effective_thresholds(s, None)
    assert gate.breaches(s, th).count() == 0


def test_newly_stale_and_given_metrics(spark):
    facts = spark.createDataFrame([("r", "s", "x:f", 7, 9, 19)], KEY + "id string, cc int, cognitive int, loc int")
    f = spark.createDataFrame([("r", "s", "x:f", "func", "f", "x:p", "x", "x/f.py", 3, 21)], NODE)
    cov = spark.createDataFrame([], KEY + "id string, stmts long, covered long, percent double, stale boolean, lines_known boolean, reached boolean")
    mu = spark.createDataFrame([], KEY + "id string, killed long, survived long, not_covered long, timed_out long, score double, stale boolean")
    mt = spark.createDataFrame([], KEY + "id string, line int, status string")
    st = spark.createDataFrame([], KEY + "id string, line int, state string")
    given = spark.createDataFrame(
        [("r", "s", "x:f", 12, 9, 75.0, False, True, True, 7.9, 6, 2, 1, 0, 75.0, False, 1)],
        KEY + "id string, stmts long, covered long, percent double, coverage_stale boolean, lines_known boolean, reached boolean, crap double, killed long, survived long, not_covered long, timed_out long, score double, mutation_stale boolean, testable long",
    )
    got = metrics.function_metrics(f, facts, cov, mu, mt, st, given=given)
    assert pairs(got, "crap", "percent", "score", "grade_crap", "grade_mutation", "grade_coverage", "grade_combined", "churn") == [(7.9, 75.0, 75.0, 8, 6, 6, 7, None)]
