"""Folding against brute force: rings, trees behind rings, chains, sparse random graphs."""

from __future__ import annotations

import random

from conftest import pairs
from plumbline.operators import folding, graph
from test_graph import frame, make, reach


def counted(monkeypatch):
    """How often a round is written, by the modules under test."""
    n = []
    for module in (graph, folding):
        inner = module.settle
        monkeypatch.setattr(module, "settle", lambda df, label, f=inner: n.append(label) or f(df, label))
    return n


def ring(name, n):
    return {(f"{name}{i:05d}", f"{name}{(i + 1) % n:05d}") for i in range(n)}


def chain(name, n):
    return {(f"{name}{i:05d}", f"{name}{i + 1:05d}") for i in range(n)}


def test_cycles_of_sparse_graphs(spark):
    graphs = {f"g{seed:02d}": make(seed, 30, 30 + seed % 9, False) for seed in range(24)}
    graphs["ring"] = ring("r", 9) | {("r00003", "t1"), ("t1", "t2"), ("t2", "t3"), ("t1", "t4")}
    graphs["two rings"] = ring("p", 4) | ring("q", 7) | {("p00001", "m1"), ("m1", "m2"), ("m2", "q00002")}
    graphs["eight"] = ring("p", 4) | ring("q", 5) | {("p00000", "x"), ("x", "q00000"), ("q00003", "y"), ("y", "p00002")}
    graphs["loops"] = {("x", "x"), ("x", "y"), ("y", "y"), ("y", "z")}
    want = []
    for r, es in graphs.items():
        to = reach(es)
        want += [(r, a, b) for a, b in es if a in to[b] or a == b]
    assert pairs(graph.cyclic_edges(frame(spark, graphs)), "repo", "from", "to") == sorted(want, key=repr)


def test_ranks_of_sparse_graphs(spark):
    graphs = {f"g{seed:02d}": make(seed, 30, 28 + seed % 20, True) for seed in range(24)}
    graphs["chain"] = chain("c", 40) | {("c00000", "c00020"), ("s", "c00030"), ("c00040", "e")}
    want = []
    for r, es in graphs.items():
        rank = {}
        for n in sorted({x for e in es for x in e} - {"s", "e"}) + ["s", "e"]:
            rank[n] = max((rank.get(a, 0) + 1 for a, b in es if b == n), default=0)
        want += [(r, n, k) for n, k in rank.items() if any(n in e for e in es)]
    assert pairs(graph.ranks(frame(spark, graphs)), "repo", "node", "rank") == sorted(want, key=repr)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = counted(monkeypatch)
    got = dict(pairs(graph.ranks(frame(spark, {"r": chain("n", 10_000)})), "node", "rank"))
    assert got == {f"n{i:05d}": i for i in range(10_001)}
    assert len(n) < 40


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n = counted(monkeypatch)
    es = ring("n", 3_000) | chain("t", 3_000) | {("n00007", "t00000")}
    assert sorted(pairs(graph.cyclic_edges(frame(spark, {"r": es})), "from", "to")) == sorted(ring("n", 3_000))
    assert len(n) < 60


def test_empty(spark):
    none = frame(spark, {"r": {("a", "b")}}).limit(0)
    assert graph.cyclic_edges(none).count() == 0
    assert graph.ranks(none).count() == 0
    folded = folding.fold(none.selectExpr("1L as a", "2L as b", "1 as w"))
    assert folded.hung.count() == 0 and folded.edges.count() == 0
