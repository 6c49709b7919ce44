"""Source lines with coverage state, surviving mutants and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import strip
from plumbline.functions.text import range_text
from plumbline.operators.intervals import lines_of
from plumbline.operators.mutation import hint, survivors
from plumbline.operators.ordered import runs_skipping_gaps
from plumbline.schemas import FUNC, SNAP, TYPE

ID = SNAP + ["id"]
# How a line starts that guards the lines after it.
HEADERS = ["if ", "else", "case ", "default:", "for ", "select"]
# How far above a run its guard is looked for.
GUARD_DISTANCE = 3
ORDER = {"not_covered": 1, "survived": 2, "note": 3}


def shown_spans(nodes: DataFrame) -> DataFrame:
    """Functions and types from their doc comment to their last line."""
    from_line = F.when(F.coalesce("doc_line", F.lit(0)) > 0, F.col("doc_line")).otherwise(F.col("line"))
    return nodes.where(F.col("kind").isin(FUNC, TYPE)).select(
        *ID, "file", from_line.alias("line"), F.greatest("end_line", from_line).alias("end_line")
    )


def _guard(text: Column) -> Column:
    """The header a line holds, without its brace; NULL for other lines."""
    t = strip(F.regexp_replace(strip(text), r"^\}", ""))
    is_header = F.lit(False)
    for h in HEADERS:
        is_header = is_header | t.startswith(h)
    return F.when(is_header, strip(F.regexp_replace(t, r"\{$", "")))


def stated_lines(spans: DataFrame, source_lines: DataFrame, states: DataFrame, mutants: DataFrame) -> DataFrame:
    """``…, id, n, text, state, survived`` for every shown line."""
    lived = survivors(mutants).groupBy(*ID, F.col("line").alias("n")).agg(F.count("*").alias("survived"))
    return (
        lines_of(spans, source_lines)
        .join(states.select(*ID, F.col("line").alias("n"), "state"), ID + ["n"], "left")
        .join(lived, ID + ["n"], "left")
        .select(*ID, "n", "text", "state", F.coalesce("survived", F.lit(0)).alias("survived"))
    )


def uncovered_heads(lines: DataFrame) -> DataFrame:
    """Runs of uncovered lines that only covered or partial lines end, with
    the guard just above their first line: ``…, id, start, end, guard``."""
    st = F.col("state")
    run = runs_skipping_gaps(lines.where("state IS NOT NULL"), ID, "n", st == "uncovered", st.isin("covered", "partial"))
    near = run.select(*ID, "start", "end", F.explode(F.sequence(F.col("start") - GUARD_DISTANCE, F.col("start"))).alias("n"))
    guard = F.max(F.when(F.col("_g").isNotNull(), F.struct("n", "_g")))
    own = F.max(F.when(F.col("n") == F.col("start"), strip("text")))
    return (
        near.join(lines.select(*ID, "n", "text", _guard(F.col("text")).alias("_g")), ID + ["n"])
        .groupBy(*ID, "start", "end")
        .agg(guard.alias("_m"), own.alias("_own"))
        .select(*ID, "start", "end", F.coalesce("_m._g", "_own").alias("guard"))
    )


def annotations(lines: DataFrame, mutants: DataFrame, placed: DataFrame) -> DataFrame:
    """What is shown under lines: ``…, id, n, ord, kind, title, detail, why,
    note_id, author, outdated``.

    ``placed``: open notes with their ``target`` and ``line``. A line shows
    its uncovered run first, then its survivors, then its notes.
    """
    none = F.lit(None).cast("string")
    no = F.lit(None).cast("boolean")
    head = uncovered_heads(lines).select(
        *ID,
        F.col("start").alias("n"),
        F.lit(ORDER["not_covered"]).alias("ord"),
        F.lit("not_covered").alias("kind"),
        F.lit("Never run by tests").alias("title"),
        F.col("guard").alias("detail"),
        F.when(F.col("end") > F.col("start"), F.concat(F.lit("lines "), range_text("start", "end"))).alias("why"),
        none.alias("note_id"),
        none.alias("author"),
        no.alias("outdated"),
    )
    here = lines.select(*ID, "n")
    notes = placed.select(
        *SNAP, F.col("target").alias("id"), F.col("line").alias("n"), F.col("id").alias("note_id"), "author", "text", "created", "outdated"
    ).join(here, ID + ["n"], "left_semi")
    first_note = notes.groupBy(*ID, "n").agg(F.min(F.struct("created", "note_id", "text")).alias("_note"))
    group = F.sort_array(F.collect_list(F.struct("col", "type", "description")))
    n = F.size("_m")
    survived = (
        survivors(mutants)
        .withColumn("n", F.col("line").cast("long"))
        .groupBy(*ID, "n")
        .agg(group.alias("_m"))
        .join(here, ID + ["n"], "left_semi")
        .join(first_note, ID + ["n"], "left")
        .select(
            *ID,
            "n",
            F.lit(ORDER["survived"]).alias("ord"),
            F.lit("survived").alias("kind"),
            F.when(n == 1, F.lit("1 mutant survived"))
            .otherwise(F.concat(n.cast("string"), F.lit(" mutants survived")))
            .alias("title"),
            F.array_join(F.transform("_m", lambda m: m["description"]), "   ·   ").alias("detail"),
            F.coalesce("_note.text", hint(F.element_at("_m", 1)["type"])).alias("why"),
            none.alias("note_id"),
            none.alias("author"),
            no.alias("outdated"),
        )
    )
    author = F.when(F.col("author") == "user", F.lit("you")).otherwise(F.col("author"))
    noted = notes.select(
        *ID,
        "n",
        F.lit(ORDER["note"]).alias("ord"),
        F.lit("note").alias("kind"),
        F.concat(F.lit("Note from "), author).alias("title"),
        none.alias("detail"),
        F.col("text").alias("why"),
        "note_id",
        "author",
        "outdated",
    )
    return head.unionByName(survived).unionByName(noted)
