"""Operator 9, URL filtering by association rules (DataFrame functions only).

Stated rules (host, path) come first: the longest one whose host is the URL's host or
a parent domain of it and whose path the URL's path starts with. For other URLs
FP-growth mines frequent combinations of URL tokens from labelled pages; those
that go along with the label "block" often enough (support, an absolute number
of pages, confidence and lift) are rules. Tokens on exactly the same labelled
pages are mined as one item, so that a URL of many tokens on many pages does not
make every combination of them a set of its own; a URL has the item if it has one of
its tokens, which is what the rules of the single tokens would say. Each mined rule is listed in an index
under its rarest token; a URL looks its tokens up there and a rule fires if the
URL has all its tokens. A URL on which a rule fires is blocked, others are allowed.

Verdicts depend on the URL alone, so distinct URLs are judged and the verdicts
joined back; a URL with a third of all pages is judged once.

Defined results: a null url, or one without ``://``, has an empty host and path and
no tokens, so it is allowed unless a stated rule has an empty host; repeated rows are judged alike; two
stated rules of one length: the one later in the alphabet; without labelled pages
nothing is mined; an empty table gives no rows. Only page_id and url are read of pages,
doc_id, quality and toxic of labels; null labels count as good.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small

BLOCK = "#block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct runs of letters and digits after the scheme."""
    rest = F.lower(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    return F.coalesce(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))), F.array().cast("array<string>"))


def stated(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(url, rule, verdict) of the longest stated rule (host, path, verdict) that fits, where one does."""
    spark = urls.sparkSession
    listed = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    up = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    u = urls.where("url is not null").select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    u = u.withColumn("labels", F.split("host", r"\.")).select("url", "path", F.explode(up).alias("rule_host"))
    fits = u.join(small(settle(listed, "url-rules"), 128), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(name.alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(F.length(name), name))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.*")


def merged(pages: DataFrame, least: int) -> DataFrame:
    """Tokens on at least ``least`` labelled pages (page, items): token, pages, item.

    Tokens that are on exactly the same pages are one item, named by the first
    of them: whatever one of them tells, each tells. Pages are compared by
    two 64-bit sums of their numbers.
    """
    each = pages.select("page", F.explode("items").alias("token"))
    place = [F.bit_xor(F.xxhash64(F.col("page"), F.lit(k))).alias(f"p{k}") for k in (1, 2)]
    found = each.groupBy("token").agg(F.count("*").alias("pages"), *place).where(F.col("pages") >= least)
    same = Window.partitionBy("pages", "p1", "p2")
    return settle(found.select("token", "pages", F.min("token").over(same).alias("item")), "url-items")


def mine(
    labelled: DataFrame, support: float = 0.002, least_pages: int = 20, confidence: float = 0.5, lift: float = 1.5
) -> tuple[DataFrame, DataFrame]:
    """Rules from ``labelled`` (items: array of tokens, bad: boolean): antecedent, n, confidence, index
    token; and the items they speak of (``merged``), each for one or more tokens.

    A rule that is as sure without one of its items is left to the shorter one, which fires wherever it would.
    """
    spark = labelled.sparkSession
    pages = settle(labelled.select("items", "bad", F.monotonically_increasing_id().alias("page")), "labelled-urls")
    n = pages.count()
    if not n:
        rules = spark.createDataFrame([], "antecedent array<string>, n int, confidence double, token string")
        return rules, spark.createDataFrame([], "token string, pages long, item string")
    share = min(1.0, max(support, least_pages / n))
    items = merged(pages, math.ceil(share * n))
    own = pages.select("page", F.explode("items").alias("token")).join(small(items, 64), "token")
    own = own.groupBy("page").agg(F.collect_set("item").alias("own"))
    have = F.coalesce("own", F.array().cast("array<string>"))
    rows = pages.join(own, "page", "left").select(F.when(F.col("bad"), F.array_append(have, F.lit(BLOCK))).otherwise(have).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(settle(rows, "transactions"))
    found = model.associationRules.where((F.col("consequent")[0] == BLOCK) & (F.col("lift") >= lift))
    found = settle(found.select(F.array_sort("antecedent").alias("antecedent"), F.size("antecedent").alias("n"), "confidence"), "mined-rules")
    less = found.select("antecedent", "confidence", F.explode("antecedent").alias("t")).select(
        "antecedent", "confidence", F.expr("array_remove(antecedent, t)").alias("less")
    )
    short = found.select(F.col("antecedent").alias("less"), F.col("confidence").alias("short_confidence"))
    covered = less.join(short, "less").where("short_confidence >= confidence").select("antecedent").distinct()
    found = found.join(covered, "antecedent", "left_anti")
    rare = found.select("antecedent", "n", "confidence", F.explode("antecedent").alias("token")).join(items.select("token", "pages"), "token")
    rules = (
        rare.groupBy("antecedent", "n", "confidence")
        .agg(F.min_by("token", F.struct("pages", "token")).alias("token"))
        .select("antecedent", "n", "confidence", "token")
    )
    return rules, items


def fired(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(url, confidence) of the surest mined rule that fires, where one does: one whose
    every item the URL has a token of."""
    u = urls.where("url is not null").select("url", F.explode(tokens(F.col("url"))).alias("token"))
    u = u.join(small(settle(items.select("token", "item"), "item-index"), 64), "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    u = u.withColumn("token", F.explode("items")).join(small(settle(rules, "rule-index"), 256), "token")
    return u.where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **how) -> DataFrame:
    """page_id, host, path, rule, verdict, and the confidence of a mined rule that fired."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    labelled = p.join(known, "page_id").select(tokens(F.col("url")).alias("items"), "bad")
    urls = p.select("url").distinct()
    a, b = stated(urls, rules), fired(urls, *mine(labelled, **how))
    found = settle(a.join(b, "url", "full"), "url-verdicts")
    verdict = F.coalesce("verdict", F.when(F.col("confidence").isNotNull(), F.lit("block")), F.lit("allow"))
    return p.join(found, "url", "left").select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        "rule",
        verdict.alias("verdict"),
        "confidence",
    )
