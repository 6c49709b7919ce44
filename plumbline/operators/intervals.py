"""Interval joins between functions and the lines, blocks and hunks of files.

Every join has a real equality key: repository, snapshot, file and a slice of
line numbers. A function is listed once per slice it crosses, so a file with a
third of all functions is spread over its slices, and a slice only meets its
own few functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.schemas import SNAP
from plumbline.session import spread_join

# Lines per slice, as a power of two.
SLICE_BITS = 7
SLICE = 1 << SLICE_BITS
FILE = SNAP + ["file"]


def slice_of(line: Column | str) -> Column:
    return F.shiftright(line, SLICE_BITS)


def _slices(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(slice_of(start), slice_of(end)))


def function_slices(funcs: DataFrame, *more: str) -> DataFrame:
    """``repo, snapshot_id, file, _slice, id, line, end_line`` and the columns ``more``.

    Functions are far fewer than what meets them, so a join hashes them and
    need not sort the other side."""
    return (
        funcs.select(*FILE, "id", "line", "end_line", *more)
        .where("line <= end_line")
        .withColumn("_slice", _slices(F.col("line"), F.col("end_line")))
        .hint("shuffle_hash")
    )


def contained_spans(funcs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (``start_line``, ``end_line`` …) that lie inside a function, with its ``id`` and their ``_slice``.

    A contained span starts inside the function, so only the slice of its
    first line can match and no pair appears twice.
    """
    f = function_slices(funcs).withColumnRenamed("end_line", "_to")
    return (
        spans.withColumn("_slice", slice_of("start_line"))
        .join(f, FILE + ["_slice"])
        .where((F.col("start_line") >= F.col("line")) & (F.col("end_line") <= F.col("_to")))
        .drop("line", "_to")
    )


def owner_ranges(funcs: DataFrame) -> DataFrame:
    """Disjoint ranges of lines with their function: ``…, file, _slice, _lo, _hi, id``; the
    first id wins where functions overlap.

    Functions are clipped to their slices and cut wherever one of the slice starts or ends, so a
    slice has as many ranges as lines, at most. Functions move once for all of it.
    """
    first = F.col("_slice") * SLICE
    f = (
        function_slices(funcs)
        .select(
            *FILE,
            "_slice",
            "id",
            F.greatest("line", first).alias("_from"),
            F.least("end_line", first + (SLICE - 1)).alias("_to"),
            F.xxhash64(*FILE, "_slice").alias("_part"),
        )
        .repartition("_part")
    )
    place = ["_part", *FILE, "_slice"]
    cuts = f.select(*place, F.explode(F.array(F.col("_from"), F.col("_to") + 1)).alias("_lo")).distinct()
    following = F.lead("_lo").over(Window.partitionBy(*place).orderBy("_lo"))
    return (
        cuts.withColumn("_hi", following - 1)
        .join(f, place)
        .where((F.col("_from") <= F.col("_lo")) & (F.col("_hi") <= F.col("_to")))
        .groupBy(*place, "_lo", "_hi")
        .agg(F.min("id").alias("id"))
        .drop("_part")
        .hint("shuffle_hash")
    )


def with_owner(funcs: DataFrame, rows: DataFrame, spread: list[str], salts: int = 1) -> DataFrame:
    """Rows (``file``, ``line`` …) with the ``id`` of their function; rows outside every function are absent.

    Rows move once, by file and slice, and meet ranges that hold each line once, so a line that
    holds a large part of all rows is joined to a single one.
    """
    r = rows.withColumn("_slice", slice_of("line"))
    return (
        spread_join(r, owner_ranges(funcs), FILE + ["_slice"], ["line", *spread], salts)
        .where(F.col("line").between(F.col("_lo"), F.col("_hi")))
        .drop("_slice", "_lo", "_hi")
    )


def lines_of(spans: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Source lines of each span: ``…, id, n, text, base``, where ``base`` is
    the span's first line. Spans may overlap; each gets its own lines."""
    s = function_slices(spans)
    t = source_lines.select(*FILE, "n", "text").withColumn("_slice", slice_of("n"))
    return (
        t.join(s, FILE + ["_slice"])
        .where(F.col("n").between(F.col("line"), F.col("end_line")))
        .select(*SNAP, "id", "n", "text", F.col("line").alias("base"))
    )


def touches(start: Column, end: Column, deleted: Column, line: Column, end_line: Column) -> Column:
    """A hunk touches a function when they overlap; a pure deletion between
    ``start`` and the next line must lie strictly inside."""
    return F.when(deleted, (start >= line) & (start + 1 <= end_line)).otherwise((start <= end_line) & (end >= line))


def hunk_slices(hunks: DataFrame, by: list[str]) -> DataFrame:
    """Hunks clipped to each slice they cross.

    Clipping changes no answer, since the join clips a function to the same
    slice, and leaves few distinct hunks in a slice however many fall on it.
    """
    lo, hi = F.col("_slice") * SLICE, F.col("_slice") * SLICE + (SLICE - 1)
    return (
        hunks.select(*FILE, *by, "start", "end", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        .withColumn("_slice", _slices(F.col("start"), F.col("end")))
        .withColumn("start", F.when(F.col("deleted"), F.col("start")).otherwise(F.greatest(F.col("start"), lo)))
        .withColumn("end", F.when(F.col("deleted"), F.col("end")).otherwise(F.least(F.col("end"), hi)))
    )


def touched_functions(funcs: DataFrame, hunks: DataFrame) -> DataFrame:
    """Functions that any hunk touches: ``repo, snapshot_id, id``."""
    f = function_slices(funcs)
    h = hunk_slices(hunks, []).distinct().withColumnsRenamed({c: f"_h_{c}" for c in FILE})
    cond = (
        (f["repo"] == h["_h_repo"])
        & (f["snapshot_id"] == h["_h_snapshot_id"])
        & (f["file"] == h["_h_file"])
        & (f["_slice"] == h["_slice"])
        & touches(h["start"], h["end"], h["deleted"], f["line"], f["end_line"])
    )
    return f.join(h, cond, "left_semi").select(*SNAP, "id").distinct()


def commits_touching(funcs: DataFrame, hunks: DataFrame, salts: int = 1) -> DataFrame:
    """Number of commits with a hunk in each function's range: ``…, id, churn``.

    Every function gets a row, 0 without a commit. The distinct count is taken
    in two steps, first per function and commit.
    """
    h, f = hunk_slices(hunks, ["commit"]), function_slices(funcs)
    hit = (
        spread_join(h, f, FILE + ["_slice"], ["commit"], salts)
        .where(touches(F.col("start"), F.col("end"), F.col("deleted"), F.col("line"), F.col("end_line")))
        .select(*SNAP, "id", "commit")
    )
    counts = hit.groupBy(*SNAP, "id").agg(F.count_distinct("commit").alias("churn"))
    return funcs.select(*SNAP, "id").join(counts, SNAP + ["id"], "left").withColumn(
        "churn", F.coalesce("churn", F.lit(0)).cast("long")
    )
