from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import mutation

FUNCS = "repo string, snapshot_id string, id string, parent string, file string, line int, end_line int, body_hash string"
MUTANTS = "repo string, snapshot_id string, file string, line int, col int, type string, status string"


def funcs(spark, *rows):
    return spark.createDataFrame([("r", "s", *r) for r in rows], FUNCS)


def mutants(spark, *rows):
    return spark.createDataFrame([("r", "s", *r) for r in rows], MUTANTS)


def test_tally_and_attribution(spark):
    f = funcs(spark, ("p.a", "p", "a.go", 1, 20, "h"), ("p.b", "p", "a.go", 15, 30, "h"), ("p.c", "p", "c.go", 1, 3, "h"))
    m = mutants(
        spark,
        *[("a.go", 3, c, "X", "KILLED") for c in range(7)],
        *[("a.go", 5, c, "X", "LIVED") for c in range(4)],
        ("a.go", 18, 1, "X", "NOT COVERED"),
        ("a.go", 25, 1, "X", "TIMED OUT"),
        ("a.go", 25, 2, "X", "NOT VIABLE"),
        ("a.go", 99, 1, "X", "KILLED"),
    )
    got = pairs(mutation.tally(f, m), "id", "killed", "survived", "not_covered", "timed_out", "score")
    assert got == [("p.a", 7, 4, 1, 0, 63.6), ("p.b", 0, 0, 0, 1, 100.0), ("p.c", 0, 0, 0, 0, None)]
    assert mutation.attribute(f, m).where("line = 18").first()["id"] == "p.a"
    assert mutation.attribute(f, m).count() == 13


def test_describe(spark):
    text = "\tif qty >= t.Floor && a&^b == x-- { break }  // < 3"
    raw = text.encode()

    def col(tok, nth=0):
        at = -1
        for _ in range(nth + 1):
            at = raw.index(tok.encode(), at + 1)
        return at + 1

    cases = [
        (col(">="), "CONDITIONALS_NEGATION", ">= → <"),
        (col(">="), "CONDITIONALS_BOUNDARY", ">= → >"),
        (col("&&"), "INVERT_LOGICAL", "&& → ||"),
        (col("&^"), "INVERT_BITWISE", "&^ → &"),
        (col("=="), "CONDITIONALS_NEGATION", "== → !="),
        (col("--"), "INCREMENT_DECREMENT", "-- → ++"),
        (col("break"), "INVERT_LOOPCTRL", "break → continue"),
        (col("=="), "ARITHMETIC_BASE", "ARITHMETIC_BASE"),
        (col("qty"), "CONDITIONALS_NEGATION", "CONDITIONALS_NEGATION"),
        (1, "UNKNOWN", "UNKNOWN"),
    ]
    m = mutants(spark, *[("a.go", 7, c, t, "LIVED") for c, t, _ in cases], ("b.go", 1, 1, "INVERT_LOGICAL", "LIVED"))
    lines = spark.createDataFrame([("r", "s", "a.go", 7, text)], "repo string, snapshot_id string, file string, n int, text string")
    got = pairs(mutation.describe(m, lines), "file", "col", "type", "description")
    assert got == sorted([("a.go", *c) for c in cases] + [("b.go", 1, "INVERT_LOGICAL", "INVERT_LOGICAL")], key=repr)


def greedy(items, budget):
    total, out = 0, {}
    for n, (name, size) in enumerate(items):
        if n and budget > 0 and total + size > budget:
            out[name] = "skipped"
        else:
            total += size
            out[name] = "run"
    return out


@pytest.mark.parametrize("budget", [0, 1, 7, 40])
def test_run_plan_matches_a_plain_walk(spark, budget):
    rnd = random.Random(budget)
    rows, crap, pk, want = [], [], [], {}
    for repo in ["r", "q"]:
        sizes = {f"{repo}/p{i:03d}": rnd.choice([1, 1, 2, 3, 5, 6, 20, 41]) for i in range(60)}
        risk = {p: float(rnd.randint(1, 12)) for p in sizes}
        unmeasured = rnd.sample(sorted(sizes), 5)
        for p, n in sizes.items():
            pk.append((repo, "s", p, p))
            for k in range(n):
                rows.append((repo, "s", f"{p}.f{k}", p, "x.go", k, k, "h"))
                crap.append((repo, "s", f"{p}.f{k}", None if p in unmeasured else risk[p] - (k % 2)))
        order = sorted(sizes, key=lambda p: (1.0 if p in unmeasured else -risk[p], p))
        want |= greedy([(p, sizes[p]) for p in order], budget)
    pk.append(("r", "s", "r/empty", "r/empty"))
    plan = mutation.run_plan(
        spark.createDataFrame(pk, "repo string, snapshot_id string, id string, dir string"),
        spark.createDataFrame(rows, FUNCS),
        spark.createDataFrame(crap, "repo string, snapshot_id string, id string, crap double"),
        spark.createDataFrame([], "repo string, snapshot_id string, package string"),
        budget,
    )
    assert {r["package"]: r["status"] for r in plan.collect()} == want


def test_plan_leaves_current_packages_out(spark):
    f = funcs(spark, ("m/p.a", "m/p", "a.go", 1, 2, "h"), ("m/q.b", "m/q", "b.go", 1, 2, "h"), ("m/r.c", "m/r", "c.go", 1, 2, "h"))
    pk = spark.createDataFrame([("r", "s", p, p) for p in ["m/p", "m/q", "m/r"]], "repo string, snapshot_id string, id string, dir string")
    cache = spark.createDataFrame([("r", "m/p", "m/p.a", "h"), ("r", "m/q", "m/q.b", "old"), ("r", "m/r", "m/r.c", "h")], "repo string, package string, id string, body_hash string")
    runs = spark.createDataFrame([("r", p, e) for p, e in [("m/p", None), ("m/q", None), ("m/r", "failed")]], "repo string, package string, error string").withColumn("ran_at", F.current_timestamp())
    cur = mutation.current_packages(pk, f, cache, runs)
    assert pairs(cur, "package") == [("m/p",)]
    m = f.select("repo", "snapshot_id", "id").withColumn("crap", F.lit(1.0))
    got = {r["package"]: r["status"] for r in mutation.run_plan(pk, f, m, cur).collect()}
    assert got == {"m/p": "up_to_date", "m/q": "run", "m/r": "run"}
    forced = {r["package"]: r["status"] for r in mutation.run_plan(pk, f, m, cur, 2, force=True).collect()}
    assert forced == {"m/p": "run", "m/q": "run", "m/r": "skipped"}


def test_testable_not_covered(spark):
    key = "repo string, snapshot_id string, id string, "
    cases = {"case": (2, True, True), "uncovered": (2, True, True), "never": (1, True, False), "unknown": (1, False, False), "nocov": (1, None, None)}
    mu = spark.createDataFrame([("r", "s", k, v[0]) for k, v in cases.items()], key + "not_covered long")
    cov = spark.createDataFrame([("r", "s", k, v[1], v[2]) for k, v in cases.items() if v[1] is not None], key + "lines_known boolean, reached boolean")
    ms = [("case", 75), ("case", 77), ("uncovered", 75), ("uncovered", 90), ("never", 75), ("unknown", 75), ("nocov", 75)]
    m = spark.createDataFrame([("r", "s", k, n, "NOT COVERED") for k, n in ms], key + "line int, status string")
    st = spark.createDataFrame([("r", "s", "case", 71), ("r", "s", "uncovered", 71), ("r", "s", "uncovered", 90), ("r", "s", "never", 71)], key + "line int")
    got = dict(pairs(mutation.testable_not_covered(mu, cov, m, st), "id", "testable"))
    assert got == {"case": 0, "uncovered": 1, "never": 1, "unknown": 1, "nocov": 1}


def test_a_hot_line_is_attributed_the_same_with_salts(spark):
    """Most mutants sit on one line."""
    f = funcs(spark, ("p.a", "p", "a.go", 1, 300, "h"), ("p.b", "p", "a.go", 301, 310, "h"))
    rnd = random.Random(9)
    rows = [("a.go", 150 if i % 3 else rnd.randint(1, 320), i % 50, f"T{i % 7}", "LIVED") for i in range(900)]
    m = mutants(spark, *rows)
    from plumbline.operators.intervals import with_owner

    want = sorted((("p.a" if r[1] <= 300 else "p.b"), *r[1:4]) for r in rows if r[1] <= 310)
    for salts in [1, 4]:
        got = with_owner(f, m, ["col", "type"], salts)
        assert pairs(got, "id", "line", "col", "type") == sorted(want, key=repr)
