"""Operator 11, cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes. Where a token of each ends at the same byte is
a shared cut; the tokens between two neighbouring cuts are a group. Cuts are found
by halving: an interval's middle is bisected in the ends of A, the nearest end
that bisecting also finds in B is a cut, and both halves go on; an interval
without a cut inside is a leaf, a group. All intervals of a slice of texts are
halved together, so a level is a few array operations.

Tasks tokenize and align each text once and keep its links as distinct id pairs
with their number. Spark counts the pairs over the corpus. Pairs above a count
that leaves at most ``FREQUENT`` of them are sent to every task; the others, which
are rare by that choice, meet the documents in an ordinary join.

Defined results: a null or empty text, and one whose joined token bytes differ
from space + text, has no tokens, zeros and an empty ``groups``; a repeated row is
a document of its own and counts again; a null doc_id stays null; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small
from .packing import byte_level, encoder

GROUPS = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:long,n:int>>"
FREQUENT = 1 << 18  # rows of pair counts that are sent to every task, at most
SLICE_CHARS = 1 << 19


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model."""
    out = []
    for i in range(model.piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in ``a`` whose ends are also in ``b``, between ``first`` and ``last``, by halving.

    ``a`` and ``b`` are ascending ends. Interval k holds the candidates
    first[k] .. last[k] - 1, and its bounds are cuts already.
    """
    cuts = []
    i, j = first.copy(), last.copy()
    while len(i):
        i, j = i[i < j], j[i < j]
        if not len(i):
            break
        lo = np.where(i > 0, a[np.maximum(i - 1, 0)], 0)
        middle = (lo + a[j]) >> 1
        near = np.clip(np.searchsorted(a, middle), i, j - 1)
        found = np.full(len(i), -1, np.int64)
        open_, w = np.arange(len(i)), 2
        while len(open_):  # look further from the middle while no cut is met
            left, right = np.maximum(i[open_], near[open_] - w), np.minimum(j[open_], near[open_] + w)
            n = right - left
            start = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(left - start, n)
            end = a[at]
            hit = b[np.minimum(np.searchsorted(b, end), len(b) - 1)] == end
            far = np.where(hit, np.abs(end - np.repeat(middle[open_], n)), np.iinfo(np.int64).max)
            least = np.minimum.reduceat(far, start)
            best = np.flatnonzero(hit & (far == np.repeat(least, n)))
            k = np.repeat(np.arange(len(open_)), n)[best]
            found[open_[k[::-1]]] = at[best[::-1]]  # of two as near, the earlier
            whole = (left == i[open_]) & (right == j[open_])
            open_, w = open_[(found[open_] < 0) & ~whole], w * 4
        ok = found >= 0
        i, j, p = i[ok], j[ok], found[ok]
        cuts.append(p)
        i, j = np.concatenate([i, p + 1]), np.concatenate([p, j])
    return np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)


class Aligner:
    """Aligns slices of texts; made once in each task."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece

        self.encode_a = encoder(file_a, added=False)
        ranks, _ = byte_level(file_a)
        self.len_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.len_a[i] = len(token)
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        own = piece_bytes(self.model_b)
        self.len_b = np.array([len(x) for x in own], np.int64)
        self.bytes_b = np.array(own, object)
        self.marks = {
            (side, mark): np.array([f"{i}{mark}" for i in range(n)], object)
            for side, n, mark in (("a", len(self.len_a), ","), ("a", len(self.len_a), "|"), ("b", len(own), ","), ("b", len(own), ";"))
        }

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text; none where the bytes do not come back."""
        full = [k for k, t in enumerate(texts) if t]
        ids_b = self.model_b.encode([texts[k] for k in full], num_threads=1) if full else []
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        for k, b in zip(full, ids_b, strict=True):
            raw = (" " + texts[k]).encode()
            a, b = np.array(self.encode_a(" " + texts[k]), np.int64), np.array(b, np.int64)
            if self.len_a[a].sum() == len(raw) and b"".join(self.bytes_b[b].tolist()) == raw:
                out[k] = (a, b)
        return out

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and of B, groups, their text, distinct pairs and their number."""
        ids = self.tokens(texts)
        have = [k for k, x in enumerate(ids) if x]
        nothing = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = [nothing] * len(texts)
        if not have:
            return out
        a, b = (np.concatenate([ids[k][s] for k in have]) for s in (0, 1))
        na, nb = (np.cumsum([len(ids[k][s]) for k in have]) for s in (0, 1))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        inner = shared_cuts(ends_a, ends_b, np.concatenate([[0], na[:-1]]), na - 1)
        cut_a = np.sort(np.concatenate([inner, na - 1]))
        cut_b = np.searchsorted(ends_b, ends_a[cut_a])
        # the text of the groups: A's tokens of a group, then B's
        text = np.empty(len(a) + len(b), object)
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        at_a = np.arange(len(a)) + np.concatenate([[0], cut_b[:-1] + 1])[group_a]
        at_b = np.arange(len(b)) + (cut_a + 1)[group_b]
        text[at_a], text[at_b] = self.marks["a", ","][a], self.marks["b", ","][b]
        text[at_a[cut_a]], text[at_b[cut_b]] = self.marks["a", "|"][a[cut_a]], self.marks["b", ";"][b[cut_b]]
        pair = (a[cut_a] << 32) | b[cut_b]
        g = np.searchsorted(cut_a, na - 1) + 1
        lo_a = lo_b = lo_g = 0
        for k, hi_a, hi_b, hi_g in zip(have, na.tolist(), nb.tolist(), g.tolist(), strict=True):
            groups = "".join(text[lo_a + lo_b : hi_a + hi_b].tolist())[:-1]
            out[k] = (hi_a - lo_a, hi_b - lo_b, hi_g - lo_g, groups, *np.unique(pair[lo_g:hi_g], return_counts=True))
            lo_a, lo_b, lo_g = hi_a, hi_b, hi_g
        return out


def slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str | None]]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 64
        if size >= SLICE_CHARS or k + 1 == len(texts):
            yield ids[lo : k + 1], texts[lo : k + 1]
            lo, size = k + 1, 0


def token_groups(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its groups, as ``a1,a2|b1;a3|b2,b3``, and its links.

    ``links`` holds the distinct pairs (A's id << 32 | B's id) whose tokens end
    together, and how often. ``uid`` numbers the rows of one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, file_b)
        uid = TaskContext.get().partitionId() << 36
        link = pa.struct([("pair", pa.int64()), ("n", pa.int32())])
        for batch in batches:
            for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = aligner.align(texts)
                sizes = np.array([len(x[4]) for x in got])
                values = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([x[4] for x in got])), pa.array(np.concatenate([x[5] for x in got]).astype(np.int32))],
                    fields=list(link),
                )
                links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
                groups = pa.array([x[2] for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(uid, uid + len(ids)), pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array([x[0] for x in got], pa.int64()),
                        pa.array([x[1] for x in got], pa.int64()),
                        groups,
                        groups,  # an end is one token's in A and one token's in B: a link for each group
                        pa.array([x[3] for x in got], pa.string()),
                        links,
                    ],
                    ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )
                uid += len(ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, GROUPS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of settled groups: every linked pair, its number over all rows, and whether it is its B id's highest."""
    n = settle(
        aligned.select(F.explode("links").alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("links")), "pairs"
    ).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = settle(n.groupBy("b").agg(F.max("links").alias("top")), "pair-tops")
    return settle(n.join(small(top, 32), "b").select("pair", "links", (F.col("links") == F.col("top")).alias("best")), "pair-counts")


def frequent(counts: DataFrame, most: int) -> int:
    """The least number of links that at most ``most`` pairs reach, a power of two (or 1, if all are few enough)."""
    sizes = counts.groupBy(F.floor(F.log2("links")).cast("int").alias("k")).count().collect()  # at most 63 rows
    least, total = 64, 0
    for k, n in sorted(((r.k, r["count"]) for r in sizes), reverse=True):
        total += n
        if total > most:
            break
        least = k
    else:
        least = 0
    return 1 << min(least, 62)


def score_links(aligned: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Settled groups with ``n_best`` and ``count_sum`` of each row's links instead of the links."""
    counts = pair_counts(aligned)
    least = frequent(counts, most)
    sums = (
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"),
    )
    each = aligned.select("uid", F.explode("links").alias("x")).select("uid", "x.pair", F.col("x.n").alias("n"))
    met = each.join(F.broadcast(counts.where(F.col("links") >= least)), "pair", "left")
    parts = met.where(F.col("best").isNotNull()).groupBy("uid").agg(*sums)
    if least > 1:
        rare = met.where(F.col("best").isNull()).select("uid", "pair", "n").join(counts.where(F.col("links") < least), "pair")
        parts = parts.unionByName(rare.groupBy("uid").agg(*sums))
        parts = parts.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("links").join(parts, "uid", "left").select(*[c for c in aligned.columns if c != "links"], *zero)


def align_documents(docs: DataFrame, file_a: str, file_b: str, most: int = FREQUENT, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) aligned and scored: doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    ``then`` may replace the groups' text, which is longer than the document's,
    by something smaller before the rows are written.
    """
    groups = token_groups(docs, file_a, file_b)
    return score_links(settle(then(groups) if then else groups, "groups"), most).drop("uid")
