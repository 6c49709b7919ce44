"""Operator 7, line deduplication by a deletion-neighbourhood join.

A line goes when an equal line, or one within one edit of it (a character
inserted, deleted or replaced), stands earlier: at a smaller (doc_id, line
number). Whether the earlier line stays itself does not matter, so the
result does not depend on an order of removal.

1. Keys. Every line gives its own hash and, with its length in steps of eight,
   the hashes of its first and last ``c`` characters, where ``c`` follows from
   the step and is at most half of the length. One edit leaves one of the two parts
   as it was and changes the length by one at most, so lines of a pair share a key.
   One aggregation over the keys leaves those that two different lines share.
2. Windows. Lines that have such a key (*suspects*) give the hash of all but one
   of eight windows, for each window; where two different lines share one, the edit can
   only be in that window.
3. Neighbourhood. In those windows suspects emit all variants with one character
   deleted, as hashed keys, and every suspect emits itself. Two kinds of equal variants are
   joined: with the deletion at the same place (a replacement), where all lines of
   a key are within one edit of each other, and a variant equal to a whole line
   (an insertion). Lines of a key are compared with its earliest, never with
   each other.
4. The edit distance of every line and the earlier one found for it is verified.
5. Dropped lines leave their documents.

Defined results: null text is kept as null; lines without a visible character
always stay and match nothing; lines under ``min_chars`` characters match only
equal lines; rows that repeat a doc_id stand at the same places, so none of
them is earlier; a null doc_id is the smallest; an empty table gives no rows. Columns other
than doc_id and text are carried along as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small

STEP = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
VARIANTS = "key long, place int, h1 long, h2 long, ord decimal(32,0)"


def exploded(docs: DataFrame, *extra: str) -> DataFrame:
    """Lines with a visible character: h1, h2 (hash), ord (place in the corpus), n, line."""
    d = docs.select(
        F.expr("coalesce(cast(doc_id as long), -9223372036854775807L - 1)").alias("did"),
        F.col("text").cast("string").alias("text"),
        *extra,
    )
    return (
        d.select("did", *extra, F.expr("posexplode(split(text, '\\n'))").alias("pos", "line"))
        .where(r"line rlike '\\S'")
        .select(
            *extra,
            "line",
            "pos",
            F.xxhash64("line").alias("h1"),
            F.xxhash64("line", F.lit(1)).alias("h2"),
            F.expr("cast(did as decimal(20,0)) * 4294967296 + pos").cast("decimal(32,0)").alias("ord"),
            F.length("line").alias("n"),
        )
    )


def half_keys(min_chars: int) -> str:
    """Hashes of the two parts of a line for its length step; of the step below, too, at its start."""
    one = lambda b: (
        f"array(xxhash64(left(line, {STEP // 2} * {b}), {b}, 1), xxhash64(right(line, {STEP // 2} * {b}), {b}, 2))"
    )
    b = f"cast(n div {STEP} as int)"
    return (
        f"case when n < greatest({min_chars}, {2 * STEP}) then array() "
        f"when n % {STEP} = 0 then concat({one(b)}, {one(f'({b} - 1)')}) else {one(b)} end"
    )


def shared_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Keys of more than one line: (h1, h2, first) of equal lines, (h1, null, null) of parts."""
    keys = exploded(docs).select("h1", "h2", "ord", F.expr(half_keys(min_chars)).alias("parts"))
    rows = keys.select(
        F.expr("inline(concat(array(struct(h1 as k1, h2 as k2, ord as o, h1 as h)), "
               "transform(parts, x -> struct(x as k1, cast(null as long) as k2, cast(null as decimal(32,0)) as o, h1 as h))))")
    )
    return (
        rows.groupBy("k1", "k2")
        .agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        .where("(k2 is not null and n > 1) or (k2 is null and lo <> hi)")
        .select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "first")
    )


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def variant_keys(line: str, windows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the whole line (place -1) and of the variants with a character of the windows (start, end) deleted."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    power = np.cumprod(np.full(n, BASE, np.uint64))
    before = np.concatenate([[np.uint64(0)], np.cumsum(c * power)])
    at = np.unique(np.concatenate([np.arange(a, min(b, n)) for a, b in windows]))
    cut = before[at] + (before[-1] - before[at + 1]) * UNDO
    return np.concatenate([mixed(before[-1:]), mixed(cut)]), np.concatenate([[-1], at]).astype(np.int32)


def variants(suspects: DataFrame) -> DataFrame:
    """The deletion neighbourhood of lines (h1, h2, ord, line, windows): key, place, and the line's id and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in VARIANTS.replace("(32,0)", "").split(", ")]
        for b in batches:
            for i, (line, windows) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                key, place = variant_keys(line, [(w["a"], w["b"]) for w in windows])
                same = pa.array(np.full(len(key), i))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), *(b.column(k).take(same) for k in range(3))], names)

    return suspects.select("h1", "h2", "ord", "line", "windows").mapInArrow(run, VARIANTS)


def window_keys() -> str:
    """For each of eight windows: its bounds and the hash of the line without it."""
    one = lambda b: (
        f"transform(sequence(0, 7), j -> struct(xxhash64(left(line, j * {b}), right(line, (7 - j) * {b}), {b}, j) as part,"
        f" j * {b} as a, n - (7 - j) * {b} as b))"
    )
    b = f"cast(n div {STEP} as int)"
    return f"inline(case when n % {STEP} = 0 then concat({one(b)}, {one(f'({b} - 1)')}) else {one(b)} end)"


def with_windows(suspects: DataFrame) -> DataFrame:
    """The suspects that share all but a window with another, and those windows."""
    w = suspects.withColumn("n", F.length("line")).select("h1", "h2", F.expr(window_keys()))
    hot = w.groupBy("part").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("part")
    found = w.join(hot, "part", "left_semi").groupBy("h1", "h2").agg(F.collect_set(F.struct("a", "b")).alias("windows"))
    return suspects.join(found, ["h1", "h2"])


def near_lines(docs: DataFrame, parts: DataFrame, min_chars: int) -> DataFrame:
    """Lines (h1, h2) that one edit parts from an earlier one, with the earliest such place."""
    keyed = exploded(docs).select("h1", "h2", "ord", F.explode(F.expr(half_keys(min_chars))).alias("part"))
    parts = small(settle(parts.select(F.col("h1").alias("part")).distinct(), "line-parts"), 16)
    found = keyed.join(parts, "part", "left_semi").groupBy("h1", "h2").agg(F.min("ord").alias("ord"))
    found = small(settle(found, "suspect-ids"), 48)
    suspects = settle(
        exploded(docs).select("h1", "h2", "ord", "line").join(found, ["h1", "h2", "ord"], "left_semi").dropDuplicates(["h1", "h2"]),
        "suspects",
    )
    suspects = settle(with_windows(suspects), "near-suspects")
    v = settle(variants(suspects), "line-variants")
    first = v.where("place >= 0").groupBy("key", "place").agg(F.min(F.struct("ord", "h1", "h2")).alias("e"), F.count(F.lit(1)).alias("n"))
    clique = v.join(first.where("n > 1").select("key", "place", "e"), ["key", "place"]).where("ord > e.ord")
    whole = v.where("place < 0").select("key", F.struct("ord", "h1", "h2").alias("w"))
    star = v.where("place >= 0").select("key", F.struct("ord", "h1", "h2").alias("x")).join(whole, "key").where("w.ord <> x.ord")
    pairs = (
        clique.select(F.struct("h1", "h2").alias("line_id"), F.struct("e.h1", "e.h2").alias("earlier"))
        .unionByName(
            star.select(
                F.expr("if(w.ord > x.ord, struct(w.h1, w.h2), struct(x.h1, x.h2))").alias("line_id"),
                F.expr("if(w.ord > x.ord, struct(x.h1, x.h2), struct(w.h1, w.h2))").alias("earlier"),
            )
        )
        .distinct()
    )
    text = lambda name: suspects.select(F.struct("h1", "h2").alias(name), F.col("line").alias(f"{name}_line"), F.col("ord").alias(f"{name}_ord"))
    return (
        pairs.join(text("line_id"), "line_id")
        .join(text("earlier"), "earlier")
        .where(F.levenshtein("line_id_line", "earlier_line", 1) >= 0)
        .groupBy("line_id")
        .agg(F.min("earlier_ord").alias("first"))
        .select("line_id.*", "first")
    )


def dropped_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Numbers of the lines that go: did, text_hash, gone (array of int)."""
    shared = settle(shared_keys(docs, min_chars), "line-keys")
    equal = shared.where("h2 is not null")
    near = near_lines(docs, shared.where("h2 is null"), min_chars)
    first = settle(equal.unionByName(near).groupBy("h1", "h2").agg(F.min("first").alias("first")), "first-lines")
    rows = exploded(docs.withColumns({"_did": F.col("doc_id"), "_th": F.xxhash64(F.col("text").cast("string"))}), "_did", "_th")
    gone = rows.select("_did", "_th", "h1", "h2", "ord", "pos").join(small(first, 48), ["h1", "h2"]).where("ord > first")
    return gone.groupBy("_did", "_th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``docs`` with deduplicated text, and n_lines and kept_lines (which replace columns of those names)."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars)
    gone = gone.select(F.struct(F.coalesce(F.col("_did").cast("string"), F.lit("")), "_th").alias("k"), "gone")
    text = F.col("text").cast("string")
    d = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        text.alias("text"),
        F.split(text, "\n").alias("lines"),
        F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text)).alias("k"),
    )
    out = d.join(gone, "k", "left")
    kept = "transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])"
    own = [c for c in docs.columns if c not in ("n_lines", "kept_lines")]
    return out.select(
        *(F.expr(f"if(gone is null, text, concat_ws('\\n', {kept}))").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in own),
        F.expr("if(text is null, 0, size(lines))").alias("n_lines"),
        F.expr("if(text is null, 0, size(lines) - if(gone is null, 0, size(gone)))").alias("kept_lines"),
    )
