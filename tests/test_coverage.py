from __future__ import annotations

from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import coverage
from plumbline.sources import readers

FUNCS = "repo string, snapshot_id string, id string, file string, line int, end_line int, parent string, body_hash string"
BLOCKS = "repo string, snapshot_id string, file string, start_line int, start_col int, end_line int, end_col int, num_stmt int, count long"


def funcs(spark, *rows):
    return spark.createDataFrame([("r", "s", i, f, a, b, p, h) for i, f, a, b, p, h in rows], FUNCS)


def blocks(spark, *rows):
    return spark.createDataFrame([("r", "s", *r) for r in rows], BLOCKS)


def profile(spark, text, path="p"):
    rows = [("r", "s", path, line) for line in text.split("\n")]
    return spark.createDataFrame(rows, "repo string, snapshot_id string, path string, value string")


GOOD = """mode: count
example.com/m/p/a.go:3.20,4.10 1 1
example.com/m/p/a.go:3.20,4.10 1 3

example.com/m/p/a.go:5.2,6.3 2 0
C:/odd/b.go:1.1,2.2 1 1"""


def test_profile_text(spark):
    b, bad = readers.parse_profile_lines(profile(spark, GOOD))
    assert bad.count() == 0
    merged = coverage.merge_blocks(b)
    assert pairs(merged, "file", "start_line", "count") == [
        ("C:/odd/b.go", 1, 1),
        ("example.com/m/p/a.go", 3, 4),
        ("example.com/m/p/a.go", 5, 0),
    ]


def test_bad_profiles_are_rejected_whole(spark):
    bad = {
        "nomode": ("a.go:1.1,2.2 1 1", "no mode line"),
        "nocolon": ("mode: set\na.go 1.1,2.2 1 1", "missing ':'"),
        "nonumber": ("mode: set\na.go:1.1,2.x 1 1", "not a number"),
        "five": ("mode: set\na.go:1.1,2.2 1\nb.go:1.1,2.2 1 1", "want file:l.c,l.c stmts count"),
    }
    lines = profile(spark, GOOD, "good")
    for name, (text, _) in bad.items():
        lines = lines.unionByName(profile(spark, text, name))
    b, rejected = readers.parse_profile_lines(lines)
    assert pairs(rejected, "path", "reason") == sorted((n, r) for n, (_, r) in bad.items())
    assert b.count() == 4


def test_a_blank_profile_has_no_mode_line(spark):
    lines = profile(spark, GOOD, "good").unionByName(profile(spark, " \n\t\n", "blank"))
    lines = lines.unionByName(lines.limit(1).withColumns({"path": F.lit("null"), "value": F.lit(None).cast("string")}))
    b, rejected = readers.parse_profile_lines(lines)
    assert pairs(rejected, "path", "value", "reason") == [("blank", None, "no mode line"), ("null", None, "no mode line")]
    assert b.count() == 4


def test_three_kinds_of_coverage(spark):
    f = funcs(spark, ("p.a", "a.go", 1, 10, "p", "h"), ("p.b", "a.go", 20, 30, "p", "h"), ("p.c", "c.go", 1, 5, "p", "h"))
    b = blocks(spark, ("a.go", 2, 1, 4, 2, 2, 1), ("a.go", 5, 1, 6, 2, 1, 0), ("a.go", 9, 1, 11, 2, 7, 1), ("a.go", 4, 3, 5, 1, 1, 0))
    got = pairs(coverage.function_coverage(f, b), "id", "stmts", "covered", "percent")
    assert got == [("p.a", 4, 2, 50.0), ("p.b", 0, 0, None)]
    assert pairs(coverage.line_states(f, b), "line", "state") == [
        (2, "covered"),
        (3, "covered"),
        (4, "partial"),
        (5, "uncovered"),
        (6, "uncovered"),
    ]


def test_long_functions_cross_slices(spark):
    f = funcs(spark, ("p.a", "a.go", 1, 1000, "p", "h"), ("p.b", "a.go", 1001, 1001, "p", "h"))
    b = blocks(spark, *[("a.go", i, 1, i, 9, 1, i % 2) for i in range(1, 1002)])
    assert pairs(coverage.function_coverage(f, b), "id", "stmts", "covered") == [("p.a", 1000, 500), ("p.b", 1, 1)]


def test_relativize_prefers_the_longest_module(spark):
    b = blocks(spark, ("ex.com/m/a.go", 1, 1, 1, 1, 1, 1), ("ex.com/m/sub/b.go", 1, 1, 1, 1, 1, 1), ("other/c.go", 1, 1, 1, 1, 1, 1))
    mods = spark.createDataFrame([("r", "s", "ex.com/m", "."), ("r", "s", "ex.com/m/sub", "tools/sub")], "repo string, snapshot_id string, module string, dir string")
    assert pairs(coverage.relativize(b, mods), "file") == [("a.go",), ("tools/sub/b.go",)]


def test_cache_update_and_resolve(spark):
    old_f = funcs(spark, ("m/p.a", "p/a.go", 10, 20, "m/p", "h1"), ("m/q.b", "q/b.go", 1, 9, "m/q", "h2"), ("m/p.n", "p/a.go", 30, 40, "m/p", "h3"))
    cache = spark.createDataFrame(
        [("r", "m/p.gone", "x", None, 1, 1), ("r", "m/q.b", "h2", None, 5, 5), ("r", "m/pq.c", "h", None, 2, 2)],
        "repo string, id string, body_hash string, ran_at timestamp, stmts long, covered long",
    )
    lines = spark.createDataFrame([("r", "m/q.b", 2, "covered")], "repo string, id string, line_offset int, state string")
    errors = spark.createDataFrame([("r", "m/p", "old failure")], "repo string, package string, error string")
    measured = spark.createDataFrame([("r", "s", "m/p.a", 4, 2)], "repo string, snapshot_id string, id string, stmts long, covered long")
    states = spark.createDataFrame([("r", "s", "m/p.a", 12, "covered"), ("r", "s", "m/p.a", 13, "uncovered")], "repo string, snapshot_id string, id string, line int, state string")
    ran = spark.createDataFrame([("r", "m/p"), ("r", "m/q")], "repo string, package string")
    failed = spark.createDataFrame([("r", "m/q", "tests failed")], "repo string, package string, error string")
    c, l, e = coverage.update_coverage_cache(cache, lines, errors, old_f, measured, states, ran, failed, F.to_timestamp(F.lit("2024-01-01")))
    assert pairs(c, "id", "stmts") == [("m/p.a", 4), ("m/p.n", 0), ("m/pq.c", 2)]
    assert pairs(l, "id", "line_offset") == [("m/p.a", 2), ("m/p.a", 3)]
    assert pairs(e, "package", "error") == [("m/q", "tests failed")]
    moved = funcs(spark, ("m/p.a", "p/a.go", 110, 120, "m/p", "changed"), ("m/p.n", "p/a.go", 130, 140, "m/p", "h3"))
    cov, st = coverage.resolve_coverage(moved, c, l)
    assert pairs(cov, "id", "percent", "stale", "reached") == [("m/p.a", 50.0, True, True), ("m/p.n", None, False, False)]
    assert pairs(st, "line", "state") == [(112, "covered"), (113, "uncovered")]
