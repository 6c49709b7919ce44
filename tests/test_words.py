"""Line states packed 64 lines to a word, and what follows from them."""

from __future__ import annotations

import random

from bench_views import Views
from conftest import pairs
from plumbline.operators import coverage, mutation
from plumbline.plans import analyze
from plumbline.schemas import SNAP
from plumbline.session import settle
from test_shuffles import BLOCK, FUNC, plan_of

MUTANT = "repo string, snapshot_id string, file string, line int, col int, type string, status string"


def tables(spark):
    """Functions from one line to many words, one inside another, and blocks over their borders."""
    r = random.Random(7)
    place = [("p.A", 1, 1), ("p.B", 60, 70), ("p.C", 120, 700), ("p.D", 200, 330), ("p.E", 900, 963)]
    f = [("r", "s", i, i, "p", "a.go", lo, hi) for i, lo, hi in place]
    b = []
    for _ in range(400):
        at = r.randrange(1, 980)
        b += [("r", "s", "a.go", at, r.randrange(3), at + r.choice([-1, 0, 0, 1, 3, 63, 64, 200]), 1, r.randrange(4), r.randrange(2))] * r.choice([1, 2])
    m = [("r", "s", "a.go", r.randrange(1, 980), c, "X", r.choice(["NOT COVERED", "LIVED"])) for c in range(300)]
    return [settle(spark.createDataFrame(rows, t), n) for rows, t, n in ((f, FUNC, "functions"), (b, BLOCK, "blocks"), (m, MUTANT, "mutants"))]


def test_words_hold_what_spans_and_lines_tell(spark):
    f, b, m = tables(spark)
    words, spans = coverage.state_words(f, b), coverage.spans_inside(f, b)
    lines = ["id", "line", "state"]
    assert pairs(coverage.lines_of_words(words), *lines) == pairs(coverage.line_states(f, b, spans), *lines)
    measured = ["id", "stmts", "covered", "percent", "reached"]
    assert pairs(coverage.function_coverage(f, b, words), *measured) == pairs(coverage.function_coverage(f, b, spans), *measured)
    at = mutation.attribute(f, m)
    want = mutation.not_covered_on_states(at, coverage.line_states(f, b, spans))
    got = mutation.not_covered_on_words(at, words)
    assert pairs(got, "id", "on_state") == pairs(want, "id", "on_state") and got.count() > 2


def test_metrics_need_no_row_for_a_line(spark):
    f, b, m = tables(spark)
    facts = f.selectExpr(*SNAP, "id", "3 as cc", "2 as cognitive", "9 as loc")
    nodes = f.selectExpr("*", "'func' as kind")
    some, whole = (analyze.from_measurements(nodes, None, facts, b, m, lines=lines) for lines in (False, True))
    assert some.line_states is None and whole.line_states.count() > 0
    table = analyze.function_table(some)
    assert "/line-states-" not in plan_of(table) and "/state-words-" in plan_of(table)
    assert pairs(table, "id", "testable", "stmts") == pairs(analyze.function_table(whole), "id", "testable", "stmts")


def test_imports_are_read_from_written_measurements(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    before = pairs(v.nodes(), "repo", "id", "kind", "name")
    v = Views(spark, "/root/testdata/sf0.001")
    v.measurements()
    assert "lineitem.parquet" not in plan_of(v.nodes())
    assert pairs(v.nodes(), "repo", "id", "kind", "name") == before
