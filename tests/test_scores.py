from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scores


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_crap(spark):
    rows = [(5, None, None), (5, 6, 0), (11, 17, 17), (11, 17, 12), (1, 0, 0)]
    got = [r[0] for r in one(spark, "cc int, stmts int, covered int", rows, scores.crap("cc", "stmts", "covered"))]
    want = [None, 30.0, 11.0, 121 * (5 / 17) ** 3 + 11, 1.0]
    assert [g if g is None else round(g, 9) for g in got] == [w if w is None else round(w, 9) for w in want]


def test_grade_limits(spark):
    crap = {None: 1, 1.0: 10, 5.0: 10, 5.01: 8, 8.0: 8, 8.01: 6, 12.0: 6, 12.01: 4, 20.0: 4, 20.01: 2, 30.0: 2, 30.01: 1}
    got = one(spark, "v double", [(k,) for k in crap], scores.grade_crap("v"))
    assert [g[0] for g in got] == list(crap.values())
    mut = {None: 1, 90.0: 10, 89.9: 8, 80.0: 8, 79.9: 6, 70.0: 6, 69.9: 4, 55.0: 4, 54.9: 2, 40.0: 2, 39.9: 1, 0.0: 1}
    got = one(spark, "v double", [(k,) for k in mut], scores.grade_mutation("v"))
    assert [g[0] for g in got] == list(mut.values())
    cov = [(None, None, 1), (0, None, 10), (4, 90.0, 10), (4, 89.9, 8), (4, 69.9, 4), (4, 50.0, 4), (4, 49.9, 2), (4, 30.0, 2), (4, 29.9, 1)]
    got = one(spark, "s int, p double, w int", cov, scores.grade_coverage("s", "p"), "w")
    assert all(a == b for a, b in got)


def test_score_and_percent(spark):
    rows = [(0, 0, 0, None), (3, 0, 1, 75.0), (1, 2, 1, 75.0), (0, 2, 0, 100.0), (7, 0, 4, 63.6)]
    got = one(spark, "k int, t int, s int, w double", rows, scores.mutation_score("k", "t", "s"), "w")
    assert all(a == b for a, b in got)
    rows = [(0, 0, None), (12, 17, 70.6), (1, 3, 33.3), (2, 3, 66.7), (1, 8, 12.5)]
    got = one(spark, "c int, s int, w double", rows, scores.coverage_percent("c", "s"), "w")
    assert all(a == b for a, b in got)


def test_rounding_is_half_away_from_zero(spark):
    got = one(spark, "v double", [(0.25,), (-0.25,), (0.24,), (14.25,)], scores.round1(F.col("v")))
    assert [g[0] for g in got] == [0.3, -0.3, 0.2, 14.3]


def test_combined_and_graded(spark):
    rows = [(4, 4, 4), (10, 1, 6), (10, None, 10), (1, 1, 1), (10, 10, 10)]
    got = one(spark, "c int, m int, w int", rows, scores.combined("c", "m"), "w")
    assert all(a == b for a, b in got)
    rows = [(None, None, None, True), (0, None, 0, False), (0, None, 2, True), (1, 50.0, 0, True)]
    got = one(spark, "k int, s double, t int, w boolean", rows, scores.mutation_graded(F.col("k").isNotNull(), "s", "t"), "w")
    assert all(a == b for a, b in got)


def test_bands_worst_timeout(spark):
    got = one(spark, "g int", [(i,) for i in range(1, 11)], scores.severity_band("g"))
    assert [g[0] for g in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    got = one(spark, "a int, b int", [(3, None), (None, 4), (5, 2), (None, None)], scores.worst_of(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [3, 4, 2, None]
    got = one(spark, "b double", [(0.0,), (1.0,), (5.0,), (15.0,), (100.0,)], scores.timeout_factor("b"))
    assert [g[0] for g in got] == [16, 16, 4, 3, 3]
