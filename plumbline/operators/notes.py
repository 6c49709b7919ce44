"""Notes: which are open, and where they are in the current code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import strip
from plumbline.operators.ordered import nearest
from plumbline.schemas import SNAP
from plumbline.session import settle


def open_notes(notes: DataFrame, target: str | None = None, include_resolved: bool = False) -> DataFrame:
    rows = notes if include_resolved else notes.where(~F.coalesce("resolved", F.lit(False)))
    return rows if target is None else rows.where(F.col("target") == target)


def place(notes: DataFrame, function_lines: DataFrame) -> DataFrame:
    """Adds ``line`` and ``outdated`` to notes (``repo, snapshot_id, target,
    id, line_offset, line_text`` …).

    ``function_lines``: ``…, id, offset, text, base`` with the function's
    first line number ``base``. A note sits on its recorded offset while the
    trimmed text is unchanged, else on the nearest line with that text (the
    lower one on ties), else on the old offset within the function, outdated.

    Texts are compared by digest, and only distinct places are looked for, so a
    text goes through no shuffle here and a note through the last joins alone.
    """
    key = SNAP + ["target"]
    place = key + ["_t", "_off"]
    lines = settle(
        function_lines.select(
            *SNAP, F.col("id").alias("target"), F.col("offset").cast("long").alias("offset"), _digest(strip("text")).alias("_t"), "base"
        ),
        "note-lines",
    )
    span = lines.groupBy(*key).agg(F.max("base").alias("_base"), (F.max("offset") + 1).alias("_size"))
    n = notes.withColumns({"_t": _digest(F.col("line_text")), "_off": F.col("line_offset").cast("long")})
    # an unchanged line is the nearest one, at no distance
    asked = n.where("_t IS NOT NULL AND _off IS NOT NULL").select(*place).distinct()
    found = nearest(asked, lines, key + ["_t"], "_off", "offset", "_at").where("_at IS NOT NULL")
    clamped = F.least(F.col("_off"), F.greatest(F.coalesce("_size", F.lit(0)) - 1, F.lit(0)))
    line = F.coalesce("_base", F.lit(0)) + F.coalesce("_at", clamped)
    anchored = F.col("line_offset").isNotNull()
    return (
        n.join(found, place, "left")
        .join(span, key, "left")
        .select(
            *notes.columns,
            F.when(anchored, line).otherwise(0).cast("long").alias("line"),
            (anchored & F.col("_at").isNull()).alias("outdated"),
        )
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
