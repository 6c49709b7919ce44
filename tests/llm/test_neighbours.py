from __future__ import annotations

import numpy as np

from plumbline.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, part int, v string, h1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2) for i, v in rows], SCHEMA).repartition(4)


def exact(rows, every=20, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ ok[q]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(q)] = [(int(ids[keep][o]), float(s[keep][o])) for o in order]
    return out


def clusters(rng, n, d=16, centres=12):
    c = rng.standard_normal((centres, d)) * 2
    return [[float(np.float32(x)) for x in c[rng.integers(centres)] + rng.standard_normal(d)] for _ in range(n)]


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [v[i] for i in range(1, len(v) + 1)] for q, v in out.items()}


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(0)
    rows = list(enumerate(clusters(rng, 3_000)))
    got, want = lists(neighbours.search(frame(spark, rows), parts=16, sample_rows=1_000, block=64)), exact(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        true = dict(exact_scores(rows, q))
        assert all(abs(true[i] - s) < 1e-12 for i, s in found)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)


def exact_scores(rows, q):
    at = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    return [(i, float(v @ at[q])) for i, v in at.items()]


def test_bad_vectors_ties_and_a_hot_vector_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    good = clusters(rng, 120)
    rows = [(i, v) for i, v in enumerate(good)] + [(200 + i, good[0]) for i in range(60)]
    rows += [(300, None), (320, []), (340, [0.0] * 16), (360, [None] * 16), (380, [float("nan")] * 16), (400, [float("inf")] * 16), (420, [1.0] * 3)]
    rows += [(20, good[20]), (21, good[21]), (None, good[5])]
    got, want = lists(neighbours.search(frame(spark, rows), parts=8, block=16)), exact(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (7, [1.0, 1.0])]
    got = lists(neighbours.search(frame(spark, rows)))
    assert [i for i, _ in got[0]] == [20, 7] and [i for i, _ in got[20]] == [0, 7]
    assert neighbours.search(frame(spark, rows[:1])).count() == 0
    assert neighbours.search(frame(spark, [])).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = np.array(clusters(rng, 800, centres=8))
    near = neighbours.nearest(x, 10)
    part = neighbours.partition_graph(near, 8, rng)
    size = np.bincount(part, minlength=8)
    assert size.max() <= 1.15 * 100 + 1 and size.min() >= 0.85 * 100 - 1
    assert (part[near] == part[:, None]).mean() > 0.5
