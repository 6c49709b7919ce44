"""Ordered computations over long runs of rows, in two levels.

A window over one key puts all rows of the key into one task. Here rows are
cut into spans of the position; a window only ever sees one span of one key,
and a second, far smaller window carries totals from span to span. A key that
holds a third of the table is spread over as many tasks as it has spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def _spans(df: DataFrame, pos: str, span: int) -> DataFrame:
    return df.withColumn("_span", F.floor(F.col(pos) / F.lit(span)))


def running_total(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """``out`` = sum of ``value`` over the key's rows up to this position.

    Positions must be unique within a key.
    """
    d = _spans(df.withColumn("_v", value), pos, span)
    cut = keys + ["_span"]
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        d.groupBy(*cut)
        .agg(F.sum("_v").alias("_t"))
        .select(*cut, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    )
    here = Window.partitionBy(*cut).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.join(carried, cut)
        .withColumn(out, F.col("_before") + F.sum("_v").over(here))
        .drop("_v", "_span", "_before")
    )


def running_last(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    out: str,
    tie: str | None = None,
    span: int = SPAN,
    before: bool = False,
) -> DataFrame:
    """``out`` = the latest non-NULL ``value`` at or before this position; with ``before`` only of earlier rows.

    ``tie`` orders rows that share a position.
    """
    order = [pos] + ([tie] if tie else [])
    d = _spans(df.withColumn("_v", value), pos, span)
    cut = keys + ["_span"]
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        d.groupBy(*cut)
        .agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v"))).alias("_m"))
        .select(*cut, F.last("_m._v", ignorenulls=True).over(earlier).alias("_before"))
    )
    here = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return (
        d.join(carried, cut)
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(here), "_before"))
        .drop("_v", "_span", "_before")
    )


def runs(df: DataFrame, keys: list[str], line: str = "line", span: int = SPAN) -> DataFrame:
    """Maximal runs of consecutive lines: ``keys, start, end``.

    Consecutive lines share ``line − (number of lines so far)``. Runs are found within each span,
    by one shuffle of the lines; only those that touch a border of their span, at most two of a span,
    are then put together.
    """
    cut = keys + ["_span"]
    here = Window.partitionBy(*cut).orderBy(line)
    found = (
        _spans(df.select(*keys, line), line, span)
        .withColumn("_run", F.col(line) - F.dense_rank().over(here))
        .groupBy(*cut, "_run")
        .agg(F.min(line).alias("start"), F.max(line).alias("end"))
    )
    first = F.col("_span") * span
    at_border = (F.col("start") == first) | (F.col("end") == first + (span - 1))
    order = Window.partitionBy(*keys).orderBy("start")
    opens = F.when(F.col("start") - F.lag("end").over(order) == 1, 0).otherwise(1)
    whole = (
        found.where(at_border)
        .withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return found.where(~at_border).select(*keys, "start", "end").unionByName(whole.drop("_run"))


def runs_skipping_gaps(
    df: DataFrame, keys: list[str], line: str, in_run: Column, breaks: Column, span: int = SPAN
) -> DataFrame:
    """Runs of ``in_run`` rows that only a ``breaks`` row ends: rows that are
    neither lie inside a run without ending it. The run ends at its last
    ``in_run`` line."""
    relevant = df.where(in_run | breaks)
    counted = running_total(relevant, keys, line, F.when(breaks, 1).otherwise(0), "_run", span)
    return (
        counted.where(in_run)
        .groupBy(*keys, "_run")
        .agg(F.min(line).alias("start"), F.max(line).alias("end"))
        .drop("_run")
    )


def nearest(
    queries: DataFrame, points: DataFrame, keys: list[str], at: str, pos: str, out: str, span: int = SPAN
) -> DataFrame:
    """For every query row, the point of the same key closest to ``at``.

    Equal distances go to the lower position; ``out`` is NULL for a key
    without points. Queries and points are merged into one ordered stream and
    the last point seen from either side is carried, so no pairs are built.
    """
    carried = [c for c in queries.columns if c not in keys]
    payload = F.struct(*carried)
    q = queries.select(*keys, F.col(at).cast("long").alias("_pos"), F.lit(1).alias("_tie"), payload.alias("_q"))
    p = (
        points.select(*keys, F.col(pos).cast("long").alias("_pos"))
        .distinct()
        .select(*keys, "_pos", F.lit(0).alias("_tie"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"))
    )
    stream = q.unionByName(p)
    is_point = F.when(F.col("_tie") == 0, F.col("_pos"))
    low = running_last(stream, keys, "_pos", is_point, "_low", "_tie", span)
    turned = low.withColumn("_back", -F.col("_pos"))
    is_point = F.when(F.col("_tie") == 0, F.col("_pos"))
    both = running_last(turned, keys, "_back", is_point, "_high", "_tie", span).where("_tie = 1")
    d_low, d_high = F.col("_pos") - F.col("_low"), F.col("_high") - F.col("_pos")
    pick = F.when(F.col("_high").isNull() | (d_low <= d_high), F.col("_low")).otherwise(F.col("_high"))
    return both.select(*keys, *[F.col(f"_q.{c}").alias(c) for c in carried], pick.alias(out))
