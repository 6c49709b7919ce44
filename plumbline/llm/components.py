"""Connected components of an undirected graph by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); roots are node ids.

    In each round every node joins its neighbour of least hash (hashed anew in
    every round, so no chain is bad in all), and the graph between the nodes
    joined to is the next round's; it has at most two thirds of the nodes on a
    chain and one on a star. Rounds are written tables.
    """
    e = settle(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    label = None
    turn = 0
    while not e.isEmpty():
        both = e.unionByName(e.selectExpr("b as a", "a as b"))
        h = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: E731, B023
        up = both.groupBy("a").agg(F.min_by("b", h("b")).alias("b"))
        up = settle(up.select("a", F.when(h("b") < h("a"), F.col("b")).otherwise(F.col("a")).alias("up")), "parents")
        if label is None:
            label = up.selectExpr("a as node", "up as root")
        else:
            label = settle(
                label.join(up.selectExpr("a as root", "up"), "root", "left").selectExpr("node", "coalesce(up, root) as root"),
                "labels",
            )
        far = e.join(up, "a").selectExpr("up as x", "b as a").join(up, "a").selectExpr("x", "up as y").where("x <> y")
        e = settle(far.selectExpr("least(x, y) as a", "greatest(x, y) as b").distinct(), "edges")
        turn += 1
    if label is None:
        return edges.selectExpr("a as node", "b as root").limit(0)
    # parents of the last rounds may themselves have joined another node
    return _settle_roots(label)


def _settle_roots(label: DataFrame) -> DataFrame:
    """Follow roots to their own roots until none changes."""
    while True:
        own = label.selectExpr("node as root", "root as top").where("root <> top")
        moved = settle(label.join(own, "root", "left").selectExpr("node", "coalesce(top, root) as root", "top is not null as moved"), "labels")
        label = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return label
