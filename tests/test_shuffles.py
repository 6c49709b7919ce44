"""How often rows move on the way to the metrics of functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import coverage, graph, intervals, metrics, mutation, ordered
from plumbline.plans import analyze
from plumbline.schemas import SNAP
from plumbline.session import joined_by_some_keys, settle

FUNC = "repo string, snapshot_id string, id string, name string, parent string, file string, line int, end_line int"
BLOCK = "repo string, snapshot_id string, file string, start_line int, start_col int, end_line int, end_col int, num_stmt int, count long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Round|Single)", plan_of(df)))


def functions(spark):
    rows = [("r", "s", f"p.F{i}", f"F{i}", "p", "a.go", i * 60 + 1, i * 60 + 30) for i in range(5)]
    return settle(spark.createDataFrame(rows, FUNC), "functions")


def blocks(spark):
    rows = [("r", "s", "a.go", i * 60 + 2 + j, 1, i * 60 + 3 + j, 2, j + 1, (i + k) % 2) for i in range(5) for j in range(3) for k in range(2)]
    return settle(spark.createDataFrame(rows + [("r", "s", "a.go", 125, 1, 131, 2, 4, 1)], BLOCK), "blocks")


def test_blocks_move_once_on_their_way_to_functions(spark):
    spans = coverage.spans_inside(functions(spark), blocks(spark))
    assert exchanges(spans) == 2  # blocks and functions
    found = pairs(spans, "id", "start_line", "end_line", "stmts", "covered", "ran", "missed")
    # each position was reported twice, once with a hit; a block over the border of two slices is found once
    small = [(f"p.F{i}", i * 60 + 2 + j, i * 60 + 3 + j, j + 1, j + 1, True, False) for i in range(5) for j in range(3)]
    assert found == sorted([*small, ("p.F2", 125, 131, 4, 4, True, False)], key=repr)


def test_functions_are_hashed_and_what_meets_them_is_not_sorted(spark):
    hunk = "repo string, snapshot_id string, commit string, file string, start int, end int, deleted boolean"
    hunks = settle(spark.createDataFrame([("r", "s", "c", "a.go", 5, 6, False)], hunk), "hunks")
    for df in (coverage.spans_inside(functions(spark), blocks(spark)), intervals.commits_touching(functions(spark), hunks)):
        assert "ShuffledHashJoin" in plan_of(df)


def test_coverage_and_mutation_are_read_once_for_the_metrics(spark):
    f = functions(spark)
    facts = f.selectExpr(*SNAP, "id", "3 as cc", "2 as cognitive", "9 as loc")
    cov = settle(f.where("name <> 'F4'").selectExpr(*SNAP, "id", "10L as stmts", "5L as covered", "50.0D as percent", "false as stale", "true as lines_known", "name <> 'F3' as reached"), "coverage")
    mut = settle(f.where("name <> 'F2'").selectExpr(*SNAP, "id", "1L as killed", "0L as survived", "3L as not_covered", "0L as timed_out", "100.0D as score", "false as stale"), "mutation")
    at = settle(f.where("name <> 'F1'").selectExpr(*SNAP, "id", "explode(array(line, line, line + 1)) as line", "'NOT COVERED' as status"), "mutants")
    states = settle(f.selectExpr(*SNAP, "id", "line", "'covered' as state"), "states")
    m = metrics.function_metrics(f, facts, cov, mut, at, states)
    scans = re.findall(r"InMemoryFileIndex\([^)]*\)\[[^\]]*/(coverage|mutation)-", plan_of(m))
    assert sorted(scans) == ["coverage", "mutation"]
    # two of three mutants on a line with a state; none; not mutated; did not run; not covered
    assert pairs(m, "name", "testable") == [("F0", 2), ("F1", 0), ("F2", None), ("F3", 3), ("F4", 3)]


def read_of(df, label):
    return len(re.findall(rf"InMemoryFileIndex\([^)]*\)\[[^\]]*/{label}-", plan_of(df)))


def test_blocks_outside_functions_are_not_merged(spark):
    plan = plan_of(coverage.spans_inside(functions(spark), blocks(spark)))
    assert plan.index("HashAggregate") < plan.index("ShuffledHashJoin")  # printed from the result down


def test_mutants_move_once_on_their_way_to_functions(spark):
    mutant = "repo string, snapshot_id string, file string, line int, col int, type string, status string"
    rows = [("r", "s", "a.go", line, c, "X", "LIVED") for line in (1, 30, 31, 62, 129, 400) for c in (1, 2)]
    at = settle(spark.createDataFrame(rows, mutant), "mutants")
    # F2 crosses the border of two slices; the lambda inside it has the smaller id
    inner = spark.createDataFrame([("r", "s", "p.F1a", "F1a", "p", "a.go", 125, 130)], FUNC)
    found = mutation.attribute(functions(spark).unionByName(inner), at)
    assert read_of(found, "mutants") == 1
    want = [(1, "p.F0"), (30, "p.F0"), (62, "p.F1"), (129, "p.F1a")]
    assert pairs(found, "line", "id") == sorted([w for w in want for _ in (1, 2)], key=repr)


def test_lines_move_once_on_their_way_to_runs(spark):
    line = "repo string, snapshot_id string, id string, line int"
    rows = [("r", "s", "f", i) for i in [*range(4090, 4100), *range(8192, 12288), 12288, 20000, 20000]]
    runs = ordered.runs(settle(spark.createDataFrame(rows, line), "lines"), ["repo", "snapshot_id", "id"])
    assert exchanges(runs) == 3  # lines, for each of two readers (one is used again), and the runs at borders
    assert pairs(runs, "start", "end") == sorted([(4090, 4099), (8192, 12288), (20000, 20000)], key=repr)


def test_commits_of_files_are_not_counted_where_functions_have_their_own(spark):
    f = functions(spark)
    hunk = "repo string, snapshot_id string, commit string, file string, start int, end int, deleted boolean"
    hunks = settle(spark.createDataFrame([("r", "s", "c", "a.go", 5, 6, False)], hunk), "hunks")
    files = settle(spark.createDataFrame([("r", "c", None, "a.go"), ("r", "d", None, "a.go")], "repo string, commit string, ts timestamp, file string"), "commits")
    facts = f.selectExpr(*SNAP, "id", "3 as cc", "2 as cognitive", "9 as loc")
    at = spark.createDataFrame([], "repo string, snapshot_id string, file string, line int, col int, type string, status string")
    nodes = f.withColumn("kind", F.lit("func"))
    with_hunks, without = (analyze.function_table(analyze.from_measurements(nodes, None, facts, blocks(spark), at, commit_files=files, hunks=h)) for h in (hunks, None))
    assert (read_of(with_hunks, "commits"), read_of(without, "commits")) == (0, 1)
    assert pairs(with_hunks, "name", "churn", "churn_scope") == [("F0", 1, "function"), *[(f"F{i}", 0, "function") for i in range(1, 5)]]
    assert pairs(without, "name", "churn", "churn_scope") == [(f"F{i}", 2, "file") for i in range(5)]


def test_labels_move_once_for_a_node_and_not_for_each_edge(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOME", 8)  # the larger repository has several homes
    names = [("r", i, j) for i in range(12) for j in range(i)] + [("q", 0, 1), ("q", 1, 0), ("q", 1, 2), ("q", 2, 2)]
    edges = settle(spark.createDataFrame([(r, "s", f"{i}", f"{j}") for r, i, j in names] + [("r", "s", "3", "7")], "repo string, snapshot_id string, from string, to string"), "edges")
    arrows = settle(graph._numbered(edges), "arrows")
    homes = graph._homes(arrows)
    assert {(r.g, r.parts) for r in homes.collect()} == {(r.g, 9 if r.repo == "r" else 1) for r in arrows.selectExpr("repo", "xxhash64(repo, snapshot_id) as g").distinct().collect()}
    ways = graph._homed_ways(arrows.where("a <> b").select("a", "b"), homes)
    state = settle(ways.where("way = 0").selectExpr("home", "node", "node as f0", "node as g0"), "state")
    with joined_by_some_keys(spark):
        dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan_of(graph._homed_step(ways, state, ["f0", "g0"])))
    assert dealt == ["home"] * 3  # ways, states, and what a home sends to a node
    want = [("q", "0", "1"), ("q", "1", "0"), ("q", "2", "2"), ("r", "3", "7")]
    want += [("r", f"{i}", f"{j}") for r, i, j in names if r == "r" and i <= 7 and j >= 3]
    assert pairs(graph.cyclic_edges(edges), "repo", "from", "to") == sorted(want, key=repr)
