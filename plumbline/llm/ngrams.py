"""Operator 4, the n-gram Jaccard join by MinHash banding.

Documents are sets of shingles of ``width`` words (words are separated by ASCII
white space and taken as they are). Documents with equal sets are one class of
copies. The numbers of bands and of rows in a band are chosen for the target
recall at the threshold; band hashes are shuffled, classes that share one are joined
to the first of them, and the connected candidates meet in groups of bounded
size, cut into blocks, where every pair is verified on the full sets. What leaves a group are
sums and a spanning forest, one row per class, never its pairs.

Two classes with a common link, however long the chain, are one near-duplicate
class, named by its smallest doc_id.

Defined results: a text of one to ``width - 1`` words is one shingle; texts
without a word (null, empty, blank) are copies of each other and link to nothing
else; repeated rows are copies; a null ``doc_id`` names a class only if no
member has another; an empty table gives no rows; only doc_id and text are read.
Class ids are 64-bit digests of the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_thread, settle, small
from .components import components

BASE = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PIECE = 1 << 20
BLOCK_CLASSES = 2_048
BLOCK_SHINGLES = 1 << 22
COLUMNS = 4_096


def choose_bands(threshold: float, recall: float = 0.999, noise_at: float = 0.3, noise: float = 0.01) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that find a pair at ``threshold`` with the
    target recall and a pair at ``noise_at`` with at most probability ``noise``."""
    best = None
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if 1 - (1 - noise_at**rows) ** bands <= noise and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    if best is None:
        raise ValueError("no number of rows meets the recall and the noise")
    return best


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; texts are read in pieces that end at a blank."""

    def __init__(self, width: int):
        self.width = width
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self._powers(1 << 14)
        self.odd = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def _powers(self, n: int) -> None:
        self.power = np.cumprod(np.full(n, BASE, np.uint64))
        self.undo = np.cumprod(np.full(n, UNDO, np.uint64))

    def words(self, b: np.ndarray) -> np.ndarray:
        """Hashes of the words of a piece."""
        if len(b) > len(self.power):
            self._powers(2 * len(b))
        is_blank = self.blank[b]
        edge = np.flatnonzero(np.diff(is_blank, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        before = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)], out=before[1:])
        return mixed((before[end] - before[start]) * self.undo[start] + (end - start).astype(np.uint64))

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        parts, lo = [], 0
        while lo < len(b):
            hi = min(lo + PIECE, len(b))
            while hi < len(b) and not self.blank[b[hi]]:
                hi += 1
            parts.append(self.words(b[lo:hi]))
            lo = hi
        w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        k = min(self.width, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, np.uint64(k))
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * self.odd[j]
        return np.unique(mixed(h))


def set_key(s: np.ndarray) -> np.int64:
    """A digest of a set, whatever its order."""
    return np.int64(mixed((mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))).reshape(1))[0].view(np.int64))


def band_hashes(s: np.ndarray, a: np.ndarray, c: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[None, i : i + 512] * a[:, None] + c[:, None]).min(1), out=least)
    m = mixed(least.astype(np.uint64) + (np.arange(bands * rows, dtype=np.uint64) << np.uint64(32)))
    return mixed(m.reshape(bands, rows).sum(1, dtype=np.uint64)).view(np.int64)


SIGNED = "doc_id long, th long, k long, n int, bands array<long>"


def signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """Per document: text hash, class of copies, number of shingles, band hashes (none without a word)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    c = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        shingle = Shingler(width)
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            k, n, found = [], [], []
            for text in b.column(2).to_pylist():
                s = shingle(text or "")
                k.append(set_key(s))
                n.append(len(s))
                found.append(band_hashes(s, a, c, bands, rows) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "th", "k", "n", "bands"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(k, s) for the classes ``wanted`` (k, rep: a member's doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        shingle = Shingler(width)
        for b in batches:
            for k, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingle(text or "")
                if set_key(s) == k:  # another row may repeat the doc_id
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["k", "s"])

    d = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string"))
    rows = d.join(small(wanted, 32), F.col("d").eqNullSafe(F.col("rep"))).select("k", "text")
    return settle(rows.mapInArrow(run, "k long, s array<long>"), "shingle-sets").dropDuplicates(["k"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets left and right, as a matrix.

    Shingles of one set alone are left out first; the rest is multiplied in
    strips of columns, so memory is bounded by the block.
    """
    of = np.concatenate([np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)])
    nl = sum(len(s) for s in left)
    _, col, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    use = times[col] > 1
    rank = np.cumsum(times > 1) - 1
    col = rank[col]
    width = int(rank[-1]) + 1 if len(rank) else 0
    at = np.arange(len(of)) < nl
    (lr, lc), (rr, rc) = ((of[m], col[m]) for m in (use & at, use & ~at))
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lr, lc, rr, rc = lr[lo], lc[lo], rr[ro], rc[ro]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, width, COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        i, j = np.searchsorted(lc, [c, c + COLUMNS])
        x[lr[i:j], lc[i:j] - c] = 1
        i, j = np.searchsorted(rc, [c, c + COLUMNS])
        y[rr[i:j], rc[i:j] - c] = 1
        out += x @ y.T
    return out


VERIFIED = "comp long, k long, text_links long, doc_links long, root long"


def verifier(numerator: int, denominator: int):
    """Links within a group of candidates: of each class the linked texts and
    documents, and the smallest class of its part of the group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        comp, bi, bj = (int(x) for x in key)
        pdf = pdf.sort_values("k", ignore_index=True)
        sets = [np.asarray(s).view(np.uint64) for s in pdf["s"]]
        k, copies, block = (pdf[c].to_numpy() for c in ("k", "copies", "block"))
        i, j = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        size = np.array([len(s) for s in sets], np.float64)
        inter = overlaps([sets[x] for x in i], [sets[x] for x in j]).astype(np.float64)
        union = size[i][:, None] + size[j][None, :] - inter
        linked = denominator * inter >= numerator * union
        if bi == bj:
            np.fill_diagonal(linked, False)
        texts, docs = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        texts[i] += linked.sum(1)
        docs[i] += linked @ copies[j]
        if bi != bj:
            texts[j] += linked.sum(0)
            docs[j] += linked.T @ copies[i]
        root = np.arange(len(k))
        while True:  # labels spread over links until none changes
            new = root.copy()
            if len(i) and len(j):
                new[i] = np.minimum(new[i], np.where(linked, root[j][None, :], len(k)).min(1))
                new[j] = np.minimum(new[j], np.where(linked, root[i][:, None], len(k)).min(0))
            new = new[new]
            if (new == root).all():
                break
            root = new
        got = texts > 0
        return pd.DataFrame({"comp": comp, "k": k[got], "text_links": texts[got], "doc_links": docs[got], "root": k[root[got]]})

    return run


def near_classes(docs: DataFrame, threshold: tuple[int, int] = (4, 5), width: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per document: doc_id, th, class_id, copies, text_links, n_links, first_of_class.

    ``threshold`` is a fraction. ``copies`` counts the documents with an equal
    set, ``text_links`` the other sets at or above the threshold, ``n_links`` all other documents
    linked, copies among them. ``first_of_class`` marks the rows of the document that names the class.
    """
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    sig = settle(signatures(docs, width, bands, rows), "signatures")
    banded = sig.select("k", F.explode("bands").alias("band"))
    shared = settle(banded.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("band", "lo"), "bands")
    star = banded.join(small(shared, 24), "band").where("k <> lo").select(F.col("lo").alias("a"), F.col("k").alias("b"))
    comp = settle(components(star).selectExpr("node as k", "root as comp"), "candidates")
    classes = settle(sig.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes")
    members = settle(comp.join(classes, "k"), "members")
    sizes = members.groupBy("comp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = (
        members.join(sizes, "comp")
        .join(shingle_sets(docs, members.select("k", "rep"), width), "k")
        .withColumn("block", F.expr("cast(pmod(xxhash64(k), blocks) as int)"))
        .withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
        .select("comp", "k", "copies", "s", "block", "blocks", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )
    links = settle(placed.groupBy("comp", "bi", "bj").applyInPandas(verifier(*threshold), VERIFIED), "links")
    several = links.join(sizes.where("blocks > 1").select("comp"), "comp", "left_semi").selectExpr("root as a", "k as b")
    across = components(several).selectExpr("node as k", "root as top")
    sums = links.groupBy("k").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"), F.min("root").alias("root"))
    rooted = sums.join(across, "k", "left").selectExpr("k", "text_links", "doc_links", "coalesce(top, root) as root").join(classes, "k")
    rooted = settle(rooted.select("k", "text_links", "doc_links", "root", "rep", "copies"), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("k", "class_id", "copies", "text_links", "doc_links")
    alone = (
        classes.where("copies > 1")
        .join(rooted, "k", "left_anti")
        .selectExpr("k", "rep as class_id", "copies", "0L as text_links", "0L as doc_links")
    )
    info = small(settle(named.unionByName(alone), "class-info"), 48)
    return (
        sig.select("doc_id", "th", "k")
        .join(info, "k", "left")
        .select(
            "doc_id",
            "th",
            F.expr("if(copies is null, doc_id, class_id)").alias("class_id"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
            F.coalesce("text_links", F.lit(0)).cast("long").alias("text_links"),
            F.expr("coalesce(copies - 1 + doc_links, 0L)").alias("n_links"),
        )
        .withColumn("first_of_class", F.expr("doc_id <=> class_id"))
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: its smallest doc_id's first row."""
    found = settle(near_classes(docs, **how).select("doc_id", "th", "first_of_class"), "near-classes")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        name.alias("d"),
        F.struct(name.alias("d"), F.xxhash64(F.col("text").cast("string")).alias("th")).alias("k"),
    )
    drop = settle(found.where("not first_of_class").select(F.struct(name.alias("d"), "th").alias("k")).distinct(), "dropped")
    kept = d.join(small(drop, 48), "k", "left_anti")
    again = settle(found.where("first_of_class").groupBy("doc_id").count().where("count > 1").select(name.alias("d")), "repeated")
    if not again.isEmpty():  # rows that repeat the naming document: one of them stays
        some = kept.join(again, "d", "left_semi").dropDuplicates(["d"])
        kept = kept.join(again, "d", "left_anti").unionByName(some)
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))
