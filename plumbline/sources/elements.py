"""JSON documents of any size, read in splits: elements of their lists and maps as rows.

A document is cut at every opening brace, which the text reader does in splits of
the file. Whether a brace stands in a string and how deep it stands follow from
running totals over the pieces, so no task ever holds a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.operators import ordered
from plumbline.session import settle

STRING = '"[^"]*"?'
# What leads to an element, with the contents of strings blanked: a list's name,
# a map's name and the first element's, a later element's name, or nothing but a comma.
LIST = r'("_*")\s*:\s*\[\s*$'
MAP = r'("_*")\s*:\s*\{\s*"_*"\s*:\s*$'
NAME = r'("_*")\s*:\s*$'
BETWEEN = r'^\s*,\s*("_*"\s*:\s*)?$'
DONE = r"\}\s*$"
# A document is at depth 1, its lists and maps at 2, their elements at 3.
ELEMENT = 3


def _pieces(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The text behind each opening brace: ``keys, path, pos, value``; at place 0 what stands before the first.

    A split's pieces are numbered from twice its start, because it has at most
    one piece more than bytes.
    """
    full = StructType([StructField(c, StringType()) for c in ["value", *keys]])
    text = spark.read.schema(full).option("basePath", path).option("lineSep", "{").text(path)
    file = F.col("_metadata")
    rows = settle(
        text.select(
            *keys, "value", file["file_path"].alias("path"), file["file_block_start"].alias("_at"), F.monotonically_increasing_id().alias("_row")
        ),
        "json-pieces",
    )
    first = rows.groupBy("path", "_at").agg(F.min("_row").alias("_first"))
    return rows.join(first, ["path", "_at"]).select(
        *keys, "path", (F.col("_at") * 2 + F.col("_row") - F.col("_first")).alias("pos"), "value"
    )


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _without_escapes(value: str) -> Column:
    """As long as before, and every quote left begins or ends a string."""
    return F.regexp_replace(value, r"(?s)\\.", "__")


def _places(pieces: DataFrame) -> DataFrame:
    """Where each piece lies: ``path, pos, inside`` (it begins in a string), ``depth`` (at its
    beginning), ``element`` (place of the last element begun so far, else -1)."""
    plain = F.col("_plain")

    def change(text: Column) -> Column:
        return _count(text, "[") - _count(text, "]}")

    p = pieces.withColumn("_plain", _without_escapes("value")).select(
        "path",
        "pos",
        _count(plain, '"').alias("_quotes"),
        change(F.regexp_replace(plain, STRING, "")).alias("_from_outside"),
        change(F.regexp_replace(F.concat(F.lit('"'), plain), STRING, "")).alias("_from_inside"),
    )
    p = ordered.running_total(p, ["path"], "pos", F.col("_quotes"), "_q")
    p = p.withColumn("inside", (F.col("_q") - F.col("_quotes")) % 2 == 1)
    p = p.withColumn("_own", F.when(F.col("inside"), F.col("_from_inside")).otherwise(F.col("_from_outside")))
    opened = ~F.col("inside") & (F.col("pos") > 0)
    p = ordered.running_total(p, ["path"], "pos", F.col("_own") + opened.cast("int"), "_end")
    p = p.withColumn("depth", F.col("_end") - F.col("_own"))
    p = ordered.running_last(p, ["path"], "pos", F.when(opened & (F.col("depth") == ELEMENT), F.col("pos")), "element")
    return p.select("path", "pos", "inside", "depth", F.coalesce("element", F.lit(-1)).alias("element"))


def _marks_only() -> Column:
    """The piece with the contents of its strings blanked, as long as before."""
    parts = F.split(_without_escapes("value"), '"', -1)
    shift = F.col("inside").cast("int")
    return F.array_join(F.transform(parts, lambda t, i: F.when((i + shift) % 2 == 1, F.repeat(F.lit("_"), F.length(t))).otherwise(t)), '"')


def _closed_at() -> Column:
    """The place in a piece of an element where the element is closed; NULL where it goes on."""
    start = F.struct(F.col("depth").alias("d"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("found"))

    def step(s: Column, t: Column) -> Column:
        d = s["d"] + _count(t, "[") - _count(t, "]") - 1
        at = s["at"] + F.length(t) + 1
        return F.struct(d.alias("d"), at.alias("at"), F.coalesce(s["found"], F.when(d == ELEMENT - 1, at)).alias("found"))

    found = F.aggregate(F.split("_marks", r"\}", -1), start.cast("struct<d:bigint,at:bigint,found:bigint>"), step, lambda s: s["found"])
    return F.when(found <= F.length("value"), found)


def _joined(piece: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece))), lambda x: x[piece]), "")


def _named(pattern: str) -> Column:
    """The string at the pattern's first group, NULL without a match."""
    tail, key = (F.length(F.regexp_extract("_marks", pattern, i)) for i in (0, 1))
    raw = F.col("_text").substr(F.length("_text") - tail + 1, key)
    return F.when(key > 0, F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0])


def _gaps(p: DataFrame, keys: list[str]) -> DataFrame:
    """What stands between one element and the next: ``keys, path, pos`` (of the element before), ``_text``,
    ``_ends`` (a list or map is left there), ``_torn``, ``section`` (that begins there), ``name`` (of the next element)."""
    deep, inside = F.col("depth") >= ELEMENT, F.col("inside")
    behind = [F.col(c).substr((F.col("_closed") + 1).cast("int"), F.length(c)) for c in ("value", "_marks")]
    brace = F.when(F.col("pos") > 0, F.lit("{")).otherwise(F.lit(""))
    g = p.where(~deep | F.col("_closed").isNotNull()).select(
        *keys,
        "path",
        "element",
        "pos",
        F.when(deep, behind[0]).otherwise(F.concat(brace, "value")).alias("_text"),
        F.when(deep, behind[1]).otherwise(F.concat(F.when(inside, F.lit("_")).otherwise(brace), "_marks")).alias("_marks"),
    )
    g = g.groupBy(*keys, "path", F.col("element").alias("at")).agg(_joined("_text").alias("_text"), _joined("_marks").alias("_marks"))
    marks = F.col("_marks")
    ends = (F.col("at") < 0) | (F.translate(marks, "]}", "") != marks)
    leads = marks.rlike(LIST) | marks.rlike(MAP) | marks.rlike(DONE)
    return g.select(
        *keys,
        "path",
        F.col("at").alias("pos"),
        "_text",
        ends.alias("_ends"),
        F.when(ends, ~leads).otherwise(~marks.rlike(BETWEEN)).alias("_torn"),
        F.coalesce(_named(LIST), _named(MAP)).alias("section"),
        _named(NAME).alias("name"),
    )


def read_elements(spark: SparkSession, path: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(heads, elements)`` of the JSON documents below ``path`` (one in each file, in folders named by ``keys``).

    ``elements``: ``keys, path, section, name, pos, value``, one row for each object in a
    list or map of the document: the list's name, the object's name in a map (else NULL), a place that
    ascends in the file, and its text. ``heads``: ``keys, path, value, torn``: each document without
    them, one ``null`` in the stead of those of a list or map; ``torn`` if something else than a comma stands
    between elements. A head and an element must each fit in memory, a document need not.
    Documents with objects in lists of lists, or lists and maps that mix objects with other values,
    have a head that is torn or no JSON. An empty file has no rows.
    """
    pieces = _pieces(spark, path, keys)
    p = pieces.join(_places(pieces), ["path", "pos"]).withColumn("_marks", _marks_only())
    p = settle(p.withColumn("_closed", F.when(F.col("depth") >= ELEMENT, _closed_at())), "json-places")
    upto = F.coalesce("_closed", F.length("value").cast("long")).cast("int")
    inner = p.where((F.col("depth") >= ELEMENT) & (F.col("element") > 0)).withColumn(
        "_piece", F.concat(F.lit("{"), F.col("value").substr(F.lit(1), upto))
    )
    texts = inner.groupBy(*keys, "path", F.col("element").alias("at")).agg(_joined("_piece").alias("value"))
    gaps = settle(_gaps(p, keys), "json-gaps")
    led = gaps.select("path", "pos", "section", "name")
    led = ordered.running_last(led, ["path"], "pos", F.col("section"), "_section", before=True)
    led = ordered.running_last(led, ["path"], "pos", F.struct("name"), "_name", before=True)
    led = led.select("path", F.col("pos").alias("at"), F.col("_section").alias("section"), F.col("_name.name").alias("name"))
    elements = texts.join(led, ["path", "at"], "left").select(*keys, "path", "section", "name", F.col("at").alias("pos"), "value")
    text = F.concat(F.when(F.col("pos") < 0, F.lit("")).otherwise(F.lit("null")), "_text")
    kept = F.array_sort(F.collect_list(F.when(F.col("_ends"), F.struct("pos", text.alias("t")))))
    heads = gaps.groupBy(*keys, "path").agg(
        F.array_join(F.transform(kept, lambda x: x["t"]), "").alias("value"), F.bool_or("_torn").alias("torn")
    )
    return heads, elements
