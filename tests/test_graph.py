"""Graph operators against brute force on random graphs."""

from __future__ import annotations

import random

from conftest import pairs
from plumbline.operators import graph

EDGES = "repo string, snapshot_id string, from string, to string"


def make(seed, n, m, dag):
    rnd = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = rnd.randrange(n), rnd.randrange(n)
        if dag and a >= b:
            continue
        out.add((f"n{a:02d}", f"n{b:02d}"))
    return out


def reach(edges):
    out = {a: set() for e in edges for a in e}
    for a, b in edges:
        out[a].add(b)
    res = {}
    for s in out:
        seen, stack = set(), list(out[s])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(out[x])
        res[s] = seen
    return res


def frame(spark, graphs):
    return spark.createDataFrame([(r, "s", a, b) for r, es in graphs.items() for a, b in sorted(es)], EDGES)


def test_acyclic(spark):
    graphs = {"a": make(1, 14, 22, False), "b": make(2, 9, 12, True), "c": {("x", "x"), ("x", "y")}, "d": make(5, 40, 70, False)}
    want = []
    for r, es in graphs.items():
        to = reach(es)
        want += [(r, a, b) for a, b in es if a not in to[b] and a != b]
    assert pairs(graph.acyclic(frame(spark, graphs)), "repo", "from", "to") == sorted(want, key=repr)


def test_backbone_ranks_entry(spark):
    graphs = {"a": make(3, 12, 26, True), "b": make(4, 8, 10, True)}
    df = frame(spark, graphs)
    want_bb, want_rank, want_entry = [], [], []
    for r, es in graphs.items():
        to = reach(es)
        want_bb += [(r, a, b) for a, b in es if not any(m != b and b in to[m] for x, m in es if x == a)]
        nodes = {n for e in es for n in e}

        def rank(n):
            return max((rank(a) + 1 for a, b in es if b == n), default=0)

        want_rank += [(r, n, rank(n)) for n in nodes]
        entries = [n for n in nodes if not any(b == n for _, b in es)]
        best = min(entries, key=lambda n: (-len(to[n]), n))
        want_entry.append((r, best, len(to[best])))
    assert pairs(graph.backbone(df), "repo", "from", "to") == sorted(want_bb, key=repr)
    assert pairs(graph.ranks(df), "repo", "node", "rank") == sorted(want_rank, key=repr)
    assert pairs(graph.primary_entry(df), "repo", "entry", "reached") == sorted(want_entry, key=repr)


def test_backbone_keeps_cycles(spark):
    es = {("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("a", "d")}
    assert pairs(graph.backbone(frame(spark, {"r": es})), "from", "to") == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "d")]


def test_lonely_nodes_form_the_last_group(spark):
    nodes = spark.createDataFrame([("r", "s", i) for i in "abcz"], "repo string, snapshot_id string, id string")
    got = pairs(graph.rank_groups(nodes, frame(spark, {"r": {("a", "b"), ("b", "c")}})), "node", "rank")
    assert got == [("a", 0), ("b", 1), ("c", 2), ("z", 3)]


def test_reach_counts_over_word_borders(spark):
    star = {(f"s{i:03d}", "hub") for i in range(150)} | {("hub", "end")}
    df = frame(spark, {"r": star})
    src = df.selectExpr("repo", "snapshot_id", "`from` as node")
    got = dict(pairs(graph.reach_counts(df, src), "node", "reached"))
    assert got == {f"s{i:03d}": 2 for i in range(150)} | {"hub": 1}


def test_ranks_end_on_a_cycle(spark):
    es = {("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "x")}
    assert pairs(graph.ranks(frame(spark, {"r": es})), "node", "rank") == [("a", 0), ("b", 1), ("c", 0), ("d", 1), ("e", 2), ("x", 0)]


def test_long_chain_with_shortcuts(spark):
    es = {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)} | {("n00", "n09"), ("n03", "n20"), ("n19", "n20")}
    got = pairs(graph.backbone(frame(spark, {"r": es})), "from", "to")
    assert got == sorted((f"n{i:02d}", f"n{i + 1:02d}") for i in range(20))
