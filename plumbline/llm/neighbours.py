"""Operator 5, approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (``sample_rows`` vectors by a hash of their ids): the
graph of each vector's nearest neighbours is cut into balanced parts (recursive
bisection along a slow mode of the graph, then moves to the part of most neighbours
within a size limit), and a network of one hidden layer learns from a
vector in which parts its neighbours lie. The share of probability that a query
must cover is set so that the sample's own neighbours are found with the target recall.

Index: every vector goes to its most probable part. Query: a query goes to its
most probable parts until their probabilities reach that share. Parts are cut into
blocks of vectors and of queries; each pair of blocks of a part is a small
group of one task, scored exactly in double precision, and its best are merged.

A vector that occurs often is searched once and found often: of equal vectors only
the smallest ``k + 1`` ids can be among anyone's ``k`` nearest, and equal queries share their
list but for themselves. So a third of all rows being one vector fills no part.

Defined results: vectors that are null, zero, of another length than the most frequent one,
or hold a null or non-finite component take no part, nor do rows without an id; of rows that repeat an
id with different vectors, the one with the smallest hash counts; ties go to the
smaller id; with few candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_thread, settle, small

FOUND = "q1 long, q2 long, vec_id long, score double"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), h1, h2 (hash of v): one row per id, usable vectors only."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and exists(v, x -> x <> 0)"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    top = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    v = v.where(F.size("v") == (top["n"] if top else 0))
    v = v.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    return v.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))})


def nearest(x: np.ndarray, k: int, rows: int = 256) -> np.ndarray:
    """Indexes of the k vectors of largest inner product with each, itself left out."""
    out = []
    for i in range(0, len(x), rows):
        s = x[i : i + rows] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def partition_graph(near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 0.15, sweeps: int = 8) -> np.ndarray:
    """A part for every node of the graph ``near`` (neighbours by row), all of about one size."""
    n = len(near)
    part = np.zeros(n, int)

    def bisect(nodes: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[nodes] = first
            return
        inside = np.full(n, -1)
        inside[nodes] = np.arange(len(nodes))
        nb = inside[near[nodes]]
        here = nb >= 0
        x = rng.standard_normal(len(nodes))
        for _ in range(40):  # averaging over neighbours leaves the slow modes
            pulled = (np.where(here, x[nb], 0).sum(1) + x) / (here.sum(1) + 1)
            back = np.bincount(nb[here], weights=np.repeat(x, here.sum(1)), minlength=len(nodes))
            x = pulled + back / (np.bincount(nb[here], minlength=len(nodes)) + 1)
            x -= x.mean()
            x /= np.linalg.norm(x) + 1e-12
        left = count // 2
        order = np.argsort(x, kind="stable")
        cut = round(len(nodes) * left / count)
        bisect(nodes[order[:cut]], first, left)
        bisect(nodes[order[cut:]], first + left, count - left)

    bisect(np.arange(n), 0, parts)
    room = math.ceil(n / parts * (1 + slack))
    floor = math.floor(n / parts * (1 - slack))
    for _ in range(sweeps):
        votes = np.zeros((n, parts))
        for j in range(near.shape[1]):
            np.add.at(votes, (np.arange(n), part[near[:, j]]), 1)
            np.add.at(votes, (near[:, j], part), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room and size[part[i]] > floor:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    h = np.maximum((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0)
    s = h @ model["w2"] + model["b2"]
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, rng: np.random.Generator) -> dict:
    """A one-hidden-layer network from vectors to distributions over parts, by Adam."""
    n, d = x.shape
    p = target.shape[1]
    model = {
        "mean": x.mean(0), "scale": x.std() + 1e-12, "b1": np.zeros(hidden), "b2": np.zeros(p),
        "w1": rng.standard_normal((d, hidden)) * np.sqrt(2 / d), "w2": rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden),
    }
    names = ("w1", "b1", "w2", "b2")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    z = (x - model["mean"]) / model["scale"]
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            b = order[i : i + 256]
            a = z[b] @ model["w1"] + model["b1"]
            h = np.maximum(a, 0)
            s = h @ model["w2"] + model["b2"]
            e = np.exp(s - s.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - target[b]) / len(b)
            gh = (g @ model["w2"].T) * (a > 0)
            grads = {"w2": h.T @ g + 1e-4 * model["w2"], "b2": g.sum(0), "w1": z[b].T @ gh + 1e-4 * model["w1"], "b1": gh.sum(0)}
            step += 1
            rate = 0.005 * (1 - epoch / epochs)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                model[k] = model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def route(prob: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Parts by falling probability, and how many of them reach the share."""
    order = np.argsort(-prob, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(prob, order, 1), 1)
    return order, 1 + (total < share - 1e-12).sum(1).clip(max=prob.shape[1] - 1)


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = 0.97, hidden: int = 96, epochs: int = 30, seed: int = 3) -> dict:
    """The index model from the sample ``x``."""
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        d = x.shape[1] if len(x) else 1
        return {"mean": np.zeros(d), "scale": 1.0, "w1": np.zeros((d, 1)), "b1": np.zeros(1), "w2": np.zeros((1, 1)), "b2": np.zeros(1), "share": 1.0}
    near = nearest(x, min(k, len(x) - 1))
    part = partition_graph(near, parts, rng)
    target = np.zeros((len(x), parts))
    for j in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[near[:, j]]), 1 / near.shape[1])
    test = np.arange(len(x)) % 5 == 4
    model = train(x[~test], target[~test], hidden, epochs, rng)
    prob = probabilities(x, model)
    home = prob.argmax(1)  # where the index will put each vector
    order, _ = route(prob[test], 1.0)
    ranked = np.take_along_axis(prob[test], order, 1).cumsum(1)
    place = np.argsort(order, axis=1)  # rank of each part for each query
    hit_rank = np.take_along_axis(place, home[near[test]], 1)
    needed = np.where(hit_rank > 0, np.take_along_axis(ranked, np.maximum(hit_rank - 1, 0), 1), 0.0)
    # a neighbour is found if the parts before its own do not yet reach the share
    model["share"] = float(min(1.0, np.quantile(needed, recall, method="higher") + 1e-9))
    return model


def fitter(parts: int, k: int, recall: float, seed: int):
    """The fit of one task: the sample's vectors in, the index model out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        t = pa.Table.from_batches(batches).sort_by([("draw", "ascending"), ("vec_id", "ascending")])
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, parts, k, recall, seed=seed))], pa.binary())], ["model"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        return run(got) if got else iter(())

    return some


def assign(rows: DataFrame, model: dict, several: bool) -> DataFrame:
    """``rows`` (…, v last) with their most probable part, or all parts a query is sent to."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.num_columns - 1)
            prob = probabilities(v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), model)
            if several:
                order, count = route(prob, model["share"])
                at = np.repeat(np.arange(b.num_rows), count)
                part = np.concatenate([o[:c] for o, c in zip(order, count, strict=True)])
            else:
                at, part = np.arange(b.num_rows), prob.argmax(1)
            took = [c.take(pa.array(at)) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*took, pa.array(part.astype(np.int32))], [*b.schema.names, "part"])

    return rows.mapInArrow(run, f"{types}, part int")


def scorer(k: int):
    """The best k candidates of a block for every query of a block."""

    def run(key: tuple, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        if not len(queries) or not len(found):
            return pd.DataFrame({"q1": [], "q2": [], "vec_id": [], "score": []}).astype({"q1": "int64", "q2": "int64", "vec_id": "int64"})
        found = found.sort_values("vec_id", kind="stable")
        ids = found["vec_id"].to_numpy()
        s = np.stack(queries["v"].to_list()) @ np.stack(found["v"].to_list()).T
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # stable: ties stay in the order of ids
        return pd.DataFrame(
            {
                "q1": np.repeat(queries["h1"].to_numpy(), top.shape[1]),
                "q2": np.repeat(queries["h2"].to_numpy(), top.shape[1]),
                "vec_id": ids[top].ravel(),
                "score": np.take_along_axis(s, top, 1).ravel(),
            }
        )

    return run


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    parts: int = 64,
    sample_rows: int = 8_192,
    recall: float = 0.97,
    block: int = 4_096,
    seed: int = 3,
) -> DataFrame:
    """The k nearest rows found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    v = settle(clean(vectors), "vectors")
    sample = v.select(F.xxhash64(F.lit(seed), "vec_id").alias("draw"), "vec_id", "v").orderBy("draw", "vec_id").limit(sample_rows)
    # the bounded sample meets in one task, not in the driver
    fitted = settle(sample, "vector-sample").repartition(1).mapInArrow(fitter(parts, k, recall, seed), "model binary").first()
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = pickle.loads(fitted[0])
    same = F.dense_rank().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    candidates = v.withColumn("n", same).where(F.col("n") <= k + 1).select("vec_id", "v")
    queries = v.where(F.col("vec_id") % every == 0)
    asked = queries.groupBy("h1", "h2").agg(F.min_by("v", "vec_id").alias("v"))
    c = settle(assign(candidates, model, False), "indexed")
    q = settle(assign(asked, model, True), "asked")
    sizes = (
        c.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nc"))
        .join(q.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nq")), "part")
    )
    sizes = F.broadcast(settle(sizes, "part-sizes"))  # at most one row per part
    own = lambda n, *by: F.expr(f"cast(pmod(xxhash64({', '.join(by)}), {n}) as int)")
    other = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    cb = c.join(sizes, "part").select("part", own("nc", "vec_id").alias("cb"), other("nq").alias("qb"), "vec_id", "v")
    qb = q.join(sizes, "part").select("part", other("nc").alias("cb"), own("nq", "h1", "h2").alias("qb"), "h1", "h2", "v")
    got = qb.groupBy("part", "cb", "qb").cogroup(cb.groupBy("part", "cb", "qb")).applyInPandas(scorer(k + 1), FOUND)
    best = W.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    top = settle(got.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "best")
    mine = queries.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    lists = mine.join(top, ["q1", "q2"]).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
