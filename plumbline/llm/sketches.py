"""Operator 6, document fingerprints by a threshold-scaled sketch (DataFrame functions only).

A sketch holds every shingle hash below a fixed fraction of the hash space, so
it grows with the document: sketches of very unequal documents stay comparable, a
sketch of a union is the union of sketches, and the share of one found in the other
estimates containment. Shingles are ``width`` words, joined by one blank; the
hash is the first 48 bits of MD5.

A fingerprint is the MD5 of the words joined by blanks (equal texts have equal
fingerprints, also where no hash is retained), a colon and the retained hashes in
ascending order, twelve hexadecimal digits each.

The edited text of a document needs the start of the next one. Rows are numbered
by one range-partitioned sort of (doc_id, text hash) without texts; each document
then sends the part that is asked for to its predecessor, so texts are shuffled once
and no window or task sees more than its own range.

Defined results: null text is empty; a text of one to ``width - 1`` words is one
shingle; two texts without a retained hash are alike (1) if their words are equal,
else not (0); rows that repeat a doc_id follow each other by text hash; a null doc_id
comes first; an only document is its own next; an empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, small

DIGITS = 12


def words(text: Column) -> Column:
    """The words of a text, joined by one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sketch(joined: Column, width: int = 5, fraction: float = 0.25) -> Column:
    """Sorted distinct hashes (hexadecimal) of the shingles below ``fraction``, from joined words."""
    limit = format(min(round(fraction * 16**DIGITS), 16**DIGITS - 1), f"0{DIGITS}x")
    grams = F.regexp_extract_all(joined, F.lit(rf"(?<!\S)(?=(\S+(?: \S+){{{width - 1}}}))"), F.lit(1))
    grams = F.when(joined == "", F.array().cast("array<string>")).when(
        joined.rlike(rf"^\S+(?: \S+){{0,{width - 2}}}$"), F.array(joined)
    ).otherwise(grams)
    hashes = F.transform(grams, lambda g: F.substring(F.md5(g), 1, DIGITS))
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(limit))))


def fingerprint(joined: Column, hashes: Column) -> Column:
    return F.concat(F.md5(joined), F.lit(":"), F.array_join(hashes, ""))


def packed(hashes: Column) -> Column:
    """A sketch as numbers, for sending it elsewhere."""
    return F.transform(hashes, lambda h: F.conv(h, 16, 10).cast("long"))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; ``equal``: their words are the same."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - inter
    return F.when(equal, F.lit(1.0)).when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's shingles that the second has; null if it is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of all texts of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def followers(docs: DataFrame) -> DataFrame:
    """Distinct rows (did, th) with their predecessors (p_did, p_th), p_half characters asked, and times.

    A row that occurs ``c`` times precedes itself ``c - 1`` times.
    """
    rows = docs.groupBy("did", "th").agg(F.max("n_chars").alias("n"), F.count(F.lit(1)).alias("c"))
    rows = settle(rows, "fingerprint-rows")
    order = settle(
        rows.repartitionByRange("did", "th")
        .sortWithinPartitions("did", "th")
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}),
        "ordered-rows",
    )
    ends = order.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    all_parts = W.orderBy("part")  # one row per partition of the sort
    ends = ends.withColumn("before", F.lag("last").over(all_parts)).withColumn("end", F.max("last").over(W.partitionBy()))
    firsts = settle(ends.select(F.col("first").alias("at"), F.coalesce("before", "end").alias("jump")), "range-ends")
    prev = order.select(F.col("at").alias("p_at"), F.col("did").alias("p_did"), F.col("th").alias("p_th"), F.expr("n div 2").alias("p_half"))
    linked = (
        order.join(small(firsts, 16), "at", "left")
        .withColumn("p_at", F.coalesce("jump", F.col("at") - 1))
        .join(prev, "p_at")
        .select("did", "th", "c", F.expr("n div 2").alias("half"), "p_did", "p_th", "p_half")
    )
    one = linked.select("did", "th", "p_did", "p_th", "p_half", F.lit(1).cast("long").alias("times"))
    again = linked.where("c > 1").select(
        "did", "th", F.col("did").alias("p_did"), F.col("th").alias("p_th"), F.col("half").alias("p_half"), (F.col("c") - 1).alias("times")
    )
    return settle(one.unionByName(again), "followers")


def fingerprints(docs: DataFrame, width: int = 5, fraction: float = 0.25) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next and containment_edited."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.withColumns({"th": F.xxhash64("text"), "n_chars": F.length("text").cast("long")})
    links = followers(d.select("did", "th", "n_chars"))
    if not links.where("times > 1 or (p_did = did and p_th = th)").isEmpty():
        d = d.dropDuplicates(["did", "th"])  # repeated rows come back by their number below
    sent = (
        d.select("did", "th", "text")
        .join(small(links, 64), ["did", "th"])
        .withColumn("w", words(F.col("text")))
        .select(
            F.col("p_did").alias("did"),
            F.col("p_th").alias("th"),
            "times",
            F.expr("left(text, cast(p_half as int))").alias("start"),
            packed(sketch(F.col("w"), width, fraction)).alias("next_sketch"),
            F.md5("w").alias("next_words"),
        )
    )
    x = (
        d.select("did", "th", "doc_id", "n_chars", "text")
        .join(sent, ["did", "th"])
        .withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "start"))
        .withColumns({"w": words(F.col("text")), "ew": words(F.col("edited"))})
        .withColumns({"s": sketch(F.col("w"), width, fraction), "es": sketch(F.col("ew"), width, fraction)})
    )
    out = x.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("w"), F.col("s")).alias("fingerprint"),
        fingerprint(F.col("ew"), F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es"), F.col("w") == F.col("ew")).alias("near_edited"),
        likeness(packed(F.col("s")), F.col("next_sketch"), F.md5("w") == F.col("next_words")).alias("near_next"),
        containment(F.col("s"), F.col("es")).alias("containment_edited"),
        "times",
    )
    return out.withColumn("_t", F.explode(F.expr("sequence(1L, times)"))).drop("_t", "times")
