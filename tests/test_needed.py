"""What a query shows nothing of is not measured for it."""

from __future__ import annotations

import pytest

import bench_queries
from bench_views import Views
from conftest import pairs
from plumbline.plans import analyze, check
from plumbline.schemas import SNAP
from test_shuffles import blocks, functions

SMALL = "/root/testdata/sf0.001"


def test_crap_needs_no_mutants_and_no_line_states(spark):
    f = functions(spark)
    facts = f.selectExpr(*SNAP, "id", "3 as cc", "20 as cognitive", "9 as loc")
    i = analyze.from_measurements(f.selectExpr("*", "'func' as kind"), None, facts, blocks(spark), None, lines=False)
    assert i.mutants is None and i.line_states is None
    m = analyze.function_table(i)
    # of F2's ten statements, the block over the border included, all ran
    assert pairs(m, "name", "stmts", "crap", "killed", "testable", "churn") == [
        (f"F{k}", 10 if k == 2 else 6, 3.0, None, None, None) for k in range(5)
    ]
    over = check.check(m, i.mutants, i.line_states, fast=True)
    assert pairs(over["breaches"], "name", "kind") == [(f"p.F{k}", "cognitive") for k in range(5)]
    assert "details" not in over


@pytest.mark.parametrize(
    ("query", "unread"),
    [
        ("rank_all_in_scope", ["file_mutants", "hunks", "commit_files"]),
        ("riskiest_in_scope", ["file_mutants", "hunks", "commit_files"]),
        ("gate_fast_breaches", ["file_mutants", "hunks", "commit_files"]),
        ("rank_worst_cc", ["blocks", "file_mutants", "hunks", "commit_files"]),
        ("grade_bands", ["hunks", "commit_files"]),
        ("purity_after_change", ["raw_calls", "imports", "imported_modules", "nodes"]),
    ],
)
def test_a_query_measures_what_it_shows(spark, monkeypatch, query, unread):
    def never(_self):
        raise AssertionError("measured and not shown")

    for name in unread:
        monkeypatch.setattr(Views, name, never)
    assert not bench_queries.QUERIES[query](spark, SMALL).isEmpty()
