"""Folding of directed graphs: what has one predecessor only goes into it.

Edges are numbers ``a, b`` and a length ``w``, one row for a pair. A node that
one other node points to hangs on that node; chains and trees of such nodes are
followed to their tops by doubling (after k jumps a node knows the node 2^k
before it), so a chain of n nodes takes about log2(n) steps. Paths between the nodes
that stay are the same before and after, and so are their longest lengths.
A ring of nodes that hang on each other is opened at its smallest number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

# Jumps that one written round makes.
JUMPS = 2


class Folded(NamedTuple):
    """``hung``: ``node, top, far, tops`` (the nodes 1, 2, 4, … before it, or the top);
    ``jumps``: the length of ``tops``; ``edges``: what is left, loops included."""

    hung: DataFrame
    jumps: int
    edges: DataFrame


def _jump(state: DataFrame) -> DataFrame:
    before = state.selectExpr("node as top", "top as top2", "far as far2", "least as least2", "done as done2")
    return (
        state.drop("done")
        .join(before, "top", "left")
        .selectExpr(
            "node",
            "coalesce(top2, top) as top",
            "far + coalesce(far2, 0) as far",
            "least(least, least2) as least",
            "concat(tops, array(coalesce(top2, top))) as tops",
            "coalesce(done2, true) as done",
        )
    )


def fold(edges: DataFrame) -> Folded:
    """Fold all nodes with one predecessor into the tops they hang on.

    Loops count as predecessors, so a node with a loop stays. An empty table
    folds into empty tables.
    """
    hang = settle(
        edges.groupBy(F.col("b").alias("node"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("up"), F.min("w").alias("w"))
        .where("n = 1 and up <> node")
        .select("node", "up", "w"),
        "hanging",
    )
    while True:
        state = hang.selectExpr("node", "up as top", "w as far", "up as least", "array(up) as tops", "false as done")
        jumps, before = 1, None
        while True:
            for _ in range(JUMPS):
                state = _jump(state)
            state, jumps = settle(state, "jumped"), jumps + JUMPS
            left, rings = state.where("not done").agg(F.count(F.lit(1)), F.count_if(F.expr("least = node"))).first()
            # Trees get shorter with every jump; when none does, what is left stands on or behind
            # a ring, and a node that is its own smallest predecessor has seen all of its ring.
            if left == 0 or (left == before and rings):
                break
            before = left
        if left == 0:
            break
        hang = settle(hang.join(state.where("not done and least = node").select("node"), "node", "left_anti"), "hanging")
    hung = state.select("node", "top", "far", "tops")
    kept = edges.join(hung.selectExpr("node as b"), "b", "left_anti")
    moved = (
        kept.join(hung.selectExpr("node as a", "top", "far"), "a", "left")
        .groupBy(F.expr("coalesce(top, a)").alias("a"), "b")
        .agg(F.max(F.expr("w + coalesce(far, 0)")).alias("w"))
    )
    return Folded(hung, jumps, settle(moved, "folded"))


def unfold_cyclic(edges: DataFrame, folded: Folded, cyclic: DataFrame) -> DataFrame:
    """Edges ``a, b`` on cycles, from those of the folded graph (its loops are added here).

    An edge to a node that stayed is on a cycle if the edge it was moved to is. The edge on
    which a node hangs is on a cycle if such an edge leaves the node or one that hangs below it.
    """
    hung = folded.hung
    found = cyclic.select("a", "b").unionByName(folded.edges.where("a = b").select("a", "b"))
    direct = settle(
        edges.join(hung.selectExpr("node as b"), "b", "left_anti")
        .join(hung.selectExpr("node as a", "top"), "a", "left")
        .join(found.selectExpr("a as top2", "b as b2"), F.expr("coalesce(top, a) = top2 and b = b2"), "left_semi")
        .select("a", "b"),
        "cyclic",
    )
    marked = direct.selectExpr("a as node").distinct().join(hung.select("node"), "node", "left_semi")
    for k in range(folded.jumps):
        above = marked.join(hung, "node").select(F.col("tops")[k].alias("node"))
        marked = marked.unionByName(above).distinct()
        if k % 2:
            marked = settle(marked, "marked")
    below = marked.join(hung.select("node"), "node", "left_semi").withColumnRenamed("node", "b")
    return settle(direct.unionByName(edges.join(below, "b", "left_semi").select("a", "b")), "cyclic")


def unfold_ranks(folded: Folded, ranks: DataFrame) -> DataFrame:
    """``node, rank`` of all nodes, from the ranks in the folded graph.

    A top without edges there is an entry; a node without a rank there (on or
    behind a cycle) gives none to what hangs on it.
    """
    ends = folded.edges.selectExpr("a as top").unionByName(folded.edges.selectExpr("b as top"))
    alone = folded.hung.select("top").distinct().join(ends, "top", "left_anti").selectExpr("top as node", "0L as rank")
    known = ranks.unionByName(alone)
    hanging = folded.hung.join(known.withColumnRenamed("node", "top"), "top").selectExpr("node", "rank + far as rank")
    return settle(known.unionByName(hanging), "unfolded")
