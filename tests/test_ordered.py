"""Two-level ordered operators against plain loops, with one key that holds
most rows and spans far smaller than it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import pairs
from plumbline.operators import ordered


def skewed(seed: int, n: int = 400):
    rnd = random.Random(seed)
    hot = [("hot", p) for p in rnd.sample(range(-50, 900), n)]
    return hot + [(f"k{i % 7}", p) for i, p in enumerate(rnd.sample(range(900), 70))]


def test_running_total_and_last(spark):
    rnd = random.Random(1)
    rows = [(k, p, rnd.randint(-3, 9), rnd.choice([None, rnd.randint(0, 99)])) for k, p in skewed(1)]
    df = spark.createDataFrame(rows, "k string, p int, v int, w int")
    total = ordered.running_total(df, ["k"], "p", F.col("v"), "t", span=16)
    both = ordered.running_last(total, ["k"], "p", F.col("w"), "l", span=16)
    want = []
    for key in {r[0] for r in rows}:
        s, last = 0, None
        for r in sorted(x for x in rows if x[0] == key):
            s += r[2]
            last = r[3] if r[3] is not None else last
            want.append((key, r[1], s, last))
    assert pairs(both, "k", "p", "t", "l") == sorted(want, key=repr)


def test_runs(spark):
    rows = skewed(2)
    got = pairs(ordered.runs(spark.createDataFrame(rows, "k string, line int"), ["k"], span=8), "k", "start", "end")
    want = []
    for key in {r[0] for r in rows}:
        lines = sorted(p for k, p in rows if k == key)
        start = prev = lines[0]
        for p in lines[1:] + [None]:
            if p is None or p != prev + 1:
                want.append((key, start, prev))
                start = p
            prev = p
    assert got == sorted(want, key=repr)


def test_runs_skip_stateless_lines(spark):
    rows = [("f", n, s) for n, s in enumerate([None, "u", None, "u", "c", "u", "p", None, "u", "u"], 10)]
    df = spark.createDataFrame(rows, "k string, n int, s string").where("s IS NOT NULL")
    st = F.col("s")
    got = pairs(ordered.runs_skipping_gaps(df, ["k"], "n", st == "u", st.isin("c", "p"), span=2), "start", "end")
    assert got == [(11, 13), (15, 15), (18, 19)]


def test_nearest(spark):
    rnd = random.Random(3)
    points = skewed(4, 120)
    queries = [(i, "hot" if i % 3 else f"k{i % 9}", rnd.randint(-80, 950)) for i in range(200)]
    got = pairs(
        ordered.nearest(
            spark.createDataFrame(queries, "q int, k string, at int"),
            spark.createDataFrame(points, "k string, pos int"),
            ["k"],
            "at",
            "pos",
            "best",
            span=32,
        ),
        "q",
        "best",
    )
    want = []
    for q, k, at in queries:
        cand = [p for kk, p in points if kk == k]
        want.append((q, min(cand, key=lambda p: (abs(p - at), p)) if cand else None))
    assert got == sorted(want, key=repr)
