"""Operator 12, ranked lexical search term at a time with limited accumulators.

A first pass over the texts counts the terms of the stated items in every document
and keeps them as postings of the document; corpus statistics are plain
aggregates. Then each task walks its postings in shards of bounded size: within a
shard the items' terms come rarest first (by the corpus' document frequency), each
adding its exact whole-number score to the accumulators of its documents. As soon
as the bounds of an item's remaining terms cannot reach the k-th partial score, no
accumulator is made any more, and the remaining terms update the survivors only.
A shard starts with the k-th score of the task's earlier shards. Each task returns
its k best of every item; Spark ranks those. Items are taken in blocks of
``BLOCK_BYTES``, so that what a task holds of them is bounded.

Defined results: a null or empty text, or one without a term, has no score and
counts for nothing; an item without a term, or whose documents all score 0, gives
no row; a repeated row is a document of its own; among equal scores a null doc_id
comes last; repeated item rows are items of their own (a null item_id stays null);
empty tables give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

POSTINGS = "uid long, doc_id long, n long, terms array<int>, tf array<int>"
FOUND = "item long, score long, doc_id long, uid long"
BLOCK_BYTES = 4 << 20  # text of the items that one pass over the documents searches for
SHARD = 1 << 20  # postings that a task holds at once, at least one document

# A-Z in lower case; of the other ASCII characters only 0-9 and a-z belong to terms.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or "").encode().translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Rows of ``docs`` that have a term: their length and their counts of the vocabulary's terms."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 512):
                out: list[tuple] = []
                for doc, text in zip(ids[lo : lo + 512], texts[lo : lo + 512].to_pylist(), strict=True):
                    own = terms(text)
                    if own:
                        hits = sorted((number[t], c) for t, c in Counter(own).items() if t in number)
                        out.append((uid, doc, len(own), [k for k, _ in hits], [c for _, c in hits]))
                    uid += 1
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, POSTINGS)


class Shard:
    """An inverted index of some documents, and the search in it."""

    def __init__(self, n: np.ndarray, first: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, w: np.ndarray):
        """Document d's postings stand from first[d] to first[d + 1]; w: the weight of each term."""
        self.size = len(n)
        doc = np.repeat(np.arange(self.size), np.diff(first))
        order = np.argsort(terms, kind="stable")
        self.terms, self.doc = terms[order], doc[order]
        tf = tf[order].astype(np.int64)
        self.gain = w[self.terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.start = np.searchsorted(self.terms, np.arange(len(w) + 1))

    def list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.start[t], self.start[t + 1])
        return self.doc[at], self.gain[at]

    def search(self, item: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the item's k best, with exact scores, and the accumulators made.

        ``item``: its terms, rarest first. ``least``: a score that the k-th best is known to reach.
        """
        lists = [x for x in map(self.list, item) if len(x[0])]
        bounds = [int(g.max()) for _, g in lists]
        rest = sum(bounds)
        score = np.zeros(self.size, np.int64)
        made = np.zeros(0, np.int64)
        for at, (doc, gain) in enumerate(lists):
            kth = max(least, int(np.partition(score[made], -k)[-k])) if len(made) >= k else least
            if rest < kth:  # a document met from here on cannot reach the k-th
                break
            score[doc] += gain
            made = np.union1d(made, doc) if at else doc
            rest -= bounds[at]
        else:
            at = len(lists)
        for doc, gain in lists[at:]:
            where = np.searchsorted(doc, made)
            there = np.minimum(where, len(doc) - 1)
            hit = doc[there] == made
            score[made[hit]] += gain[there[hit]]
        return made, score[made], len(made)


def best_in_task(items: dict[int, list[int]], w: np.ndarray, n_docs: int, length: int, k: int):
    """A function over postings in Arrow batches that returns the task's k best of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}

        def take(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows)
            uid, n = t["uid"].to_numpy(), t["n"].to_numpy()
            ids = t["doc_id"].combine_chunks()
            null, doc_id = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists = t["terms"].combine_chunks()
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            m = 10 + (90 * n * n_docs) // length
            shard = Shard(n, first, lists.flatten().to_numpy(), t["tf"].combine_chunks().flatten().to_numpy(), m, w)
            for item, own in items.items():
                old = best.get(item)
                doc, score, _ = shard.search(own, k, int(old[0][-1]) if old and len(old[0]) == k else 0)
                new = (score, null[doc], doc_id[doc], uid[doc])
                if old:
                    new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                ok = np.flatnonzero(new[0] > 0)
                order = ok[np.lexsort((new[3][ok], new[2][ok], new[1][ok], -new[0][ok]))][:k]
                best[item] = tuple(x[order] for x in new)

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                size += len(part.column(3).flatten()) + part.num_rows
                if size >= SHARD:
                    take(held)
                    held, size = [], 0
        if held:
            take(held)
        for item, (score, null, doc, uid) in best.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(score), item)),
                    pa.array(score),
                    pa.array(doc, pa.int64(), mask=null.astype(bool)),
                    pa.array(uid),
                ],
                ["item", "score", "doc_id", "uid"],
            )

    return run


def search_block(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """The k best documents of each item of one block: item, rank, doc_id, score."""
    vocabulary = sorted({t for _, own in block for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    held = settle(postings(docs, vocabulary), "postings")
    n_docs, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[r.t] = r["count"]
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    items = {i: sorted((number[t] for t in own), key=lambda t: (df[t], vocabulary[t])) for i, own in block}
    sent = docs.sparkSession.sparkContext.broadcast((items, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = sent.value
        return best_in_task(own, weights, n_docs, length, k)(batches)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    found = held.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Returns item_id, rank, doc_id, score.
    """
    spark = docs.sparkSession
    told = settle(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")), "items")
    total = told.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * total / block_bytes))
    place = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for b in range(blocks):
        block = [(r.item, sorted(set(terms(r.text)))) for r in told.where(place == b).select("item", "text").toLocalIterator()]
        if any(own for _, own in block):
            found = search_block(docs, block, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    return out.join(told.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
