"""Operator 3, mixing sources to target weights (DataFrame functions only).

Documents are leaves' content of a tree domain / language / source. A budget of
tokens (words) runs down the tree by weight. A node holds at most ``max_epochs``
times the tokens below it; what it cannot take goes to its siblings by their
weights and only beyond the whole parent's capacity to the parent's siblings, which
is a top-down filling in which every subtree is limited by its own capacity.
A leaf reads whole epochs and then the token prefix of one more, in which its
documents stand in the order of a seeded hash.

All arithmetic is exact (whole weights and tokens). Per leaf the prefix is found
on sums of hash ranges, then on the documents of one range only, and is kept as
a cut-off hash: documents are filtered, not ranked, so a leaf with a third of
all rows is no window and texts are never shuffled for it.

Defined results: null text has no tokens; null domain, language or source is
the empty name; names without a weight have weight 1 and weight 0 gets nothing;
a leaf without tokens gives no rows; rows that share a doc_id, or have none, share a
place in the order, and at the cut the rest of the budget goes to them one after
the other, by a hash of their texts (equal texts in any order; those without a token stay); rounding down loses less than one token per node; an empty table
gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, small

LEVELS = ("_domain", "_lang", "_source")
DEC = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Number of words separated by white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, its white space as it was."""
    return F.array_join(F.slice(F.split(text, r"(?<=\S)(?=\s)"), F.lit(1), n.cast("int")), "")


def placed(docs: DataFrame, domain: Column | str, *more: Column) -> DataFrame:
    """doc_id, the leaf of every row, and ``more``."""
    domain = F.expr(domain) if isinstance(domain, str) else domain
    leaf = (domain, F.col("lang"), F.col("source"))
    names = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(leaf, LEVELS, strict=True)]
    return docs.select("doc_id", *names, *more)


def weight(column: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast(DEC)
    pairs = F.create_map(*(x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(int(v)))))
    return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(1)).cast(DEC)


def fill(children: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """``children`` (parent…, name, cap, budget of the parent) with their own budgets.

    Those whose capacity is below their share are full, smallest share first;
    the rest is divided among the others by weight.
    """
    c = children.withColumn("w", weight(name, weights)).where("w > 0")
    every = W.partitionBy(*parent)
    order = every.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), name)
    c = c.withColumns(
        {
            "used": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(DEC),
            "open_w": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).cast(DEC),
        }
    ).withColumn("full", F.expr("cap * open_w <= w * (budget - used)"))
    c = c.withColumns(
        {
            "full_cap": F.sum(F.expr("if(full, cap, 0)")).over(every).cast(DEC),
            "rest_w": F.sum(F.expr(f"if(full, cast(0 as {DEC}), w)")).over(every).cast(DEC),
        }
    )
    share = F.expr(f"cast(if(full, cap, (w * (budget - full_cap)) div rest_w) as {DEC})")
    return c.select(*parent, name, share.alias("budget"))


def budgets(
    leaves: DataFrame, budget: int | float, max_epochs: int, weights: dict[str, dict[str, int]]
) -> DataFrame:
    """Token budget of every leaf (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(DEC))
    top = leaves.agg(F.sum("tokens").alias("t"))
    total = F.lit(budget).cast(DEC) if isinstance(budget, int) else F.floor(F.col("t").cast("double") * budget).cast(DEC)
    got = top.select(F.coalesce(total, F.lit(0)).cast(DEC).alias("budget"))
    parent: list[str] = []
    for level in LEVELS:
        caps = leaves.groupBy(*parent, level).agg(F.sum("cap").cast(DEC).alias("cap"))
        joined = caps.join(got, parent) if parent else caps.join(F.broadcast(got))  # one row
        got = fill(joined, parent, level, weights.get(level[1:], {}))
        parent.append(level)
    return leaves.join(got, list(LEVELS)).select(*LEVELS, F.col("tokens").cast(DEC).alias("t"), "budget")


def draw(seed: int, epoch: Column) -> Column:
    """The place of a document in an epoch of its leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(slim: DataFrame, budget: int | float, max_epochs: int, weights: dict[str, dict[str, int]], seed: int) -> DataFrame:
    """Per leaf: whole epochs, cut-off of the next one and where the cut document starts."""
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    b = budgets(settle(leaves, "leaves"), budget, max_epochs, weights)
    b = settle(b.selectExpr(*LEVELS, "cast(budget div t as int) as whole", "cast(budget % t as long) as rest"), "budgets")
    d = (
        slim.where("tokens > 0")
        .join(small(b.where("rest > 0"), 128), list(LEVELS))
        .select(*LEVELS, "rest", "tokens", draw(seed, F.col("whole")).alias("key"))
    )
    ranges = d.groupBy(*LEVELS, "rest", F.substring("key", 1, 3).alias("range")).agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = settle(ranges.withColumn("base", before).where("base < rest and rest <= base + n").select(*LEVELS, "range", "base"), "cut-ranges")
    keys = (
        d.withColumn("range", F.substring("key", 1, 3))
        .join(small(cut, 128), [*LEVELS, "range"])
        .groupBy(*LEVELS, "rest", "base", "key")
        .agg(F.sum("tokens").alias("n"), F.count("*").alias("cut_rows"))
    )
    before = F.coalesce(F.sum("n").over(W.partitionBy(*LEVELS).orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = keys.withColumn("start", F.col("base") + before).where("start < rest and rest <= start + n")
    ends = ends.select(*LEVELS, F.col("key").alias("cut"), (F.col("rest") - F.col("start")).alias("cut_tokens"), "cut_rows")
    return settle(b.join(ends, list(LEVELS), "left").where("whole > 0 or rest > 0"), "mixture")


def shared_cut(rows: DataFrame) -> DataFrame:
    """Rows (leaf, h, tokens, cut_tokens, …) that share the place of their leaf's cut, with the
    tokens that are left for each (``_left``), in the order of ``h``.

    They are sorted and numbered once; sums run over chunks of numbers, so many
    rows without a doc_id are no window.
    """
    at = rows.orderBy(*LEVELS, "h", F.rand(seed=7)).withColumn("_at", F.monotonically_increasing_id())
    at = settle(at.withColumn("_chunk", F.expr("_at div 4096")), "cut-rows")
    earlier = W.partitionBy(*LEVELS).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = at.groupBy(*LEVELS, "_chunk").agg(F.sum("tokens").alias("_sum"))
    sums = sums.select(*LEVELS, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    above = W.partitionBy(*LEVELS, "_chunk").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("cut_tokens") - F.col("_base") - F.coalesce(F.sum("tokens").over(above), F.lit(0))
    return at.join(sums, [*LEVELS, "_chunk"]).withColumn("_left", left).drop("_at", "_chunk", "_base")


def mix(
    docs: DataFrame,
    domain: Column | str,
    budget: int | float = 0.5,
    max_epochs: int = 3,
    weights: dict[str, dict[str, int]] | None = None,
    seed: int = 1,
    only_counts: bool = False,
) -> DataFrame:
    """The chosen rows of ``docs`` (``domain``: a column or an expression), once per epoch: its columns, epoch, cut_document.

    The text of a cut document ends with the last word its leaf has budget for.

    ``budget`` is a number of tokens or a fraction of all. ``weights`` has whole
    numbers by level ("domain", "lang", "source") and name. With ``only_counts``
    the rows have doc_id, domain, lang, source, epoch, tokens and kept_tokens.
    """
    count, digest = tokens(F.col("text")).alias("tokens"), F.xxhash64(F.col("text").cast("string")).alias("h")
    slim = settle(placed(docs, domain, count, digest), "token-counts")
    p = plan(slim, budget, max_epochs, weights or {}, seed)
    if not only_counts:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        slim = placed(docs, domain, count, digest, row)
    rows = slim.join(small(p, 160), list(LEVELS))
    key = draw(seed, F.col("whole"))
    rows = rows.withColumn("_part", F.when(key < F.col("cut"), 1).when(key == F.col("cut"), 2).otherwise(0))
    shared = F.expr("_part = 2 and cut_rows > 1")
    one = rows.withColumn("_left", F.col("cut_tokens"))
    if not p.where("cut_rows > 1").isEmpty():
        one = one.where(~shared).unionByName(shared_cut(rows.where(shared)))
    rows = one.withColumn("_n", F.expr("whole + if(_part = 1 or (_part = 2 and (_left > 0 or tokens = 0)), 1, 0)")).where("_n > 0")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0, _n - 1)")))
    cut = F.expr("epoch = whole and _part = 2")
    left = F.greatest(F.lit(0), "_left")
    if only_counts:
        return rows.select(
            "doc_id",
            *(F.col(c).alias(c[1:]) for c in LEVELS),
            "epoch",
            "tokens",
            F.when(cut, F.least(F.col("tokens"), left)).otherwise(F.col("tokens")).alias("kept_tokens"),
        )
    own = [c for c in docs.columns if c not in ("epoch", "cut_document")]
    text = F.col("row.`text`").cast("string")
    kept = F.when(cut & (F.col("tokens") > left), first_words(text, left)).otherwise(text).alias("text")
    return rows.select(*(kept if c == "text" else F.col(f"row.`{c}`") for c in own), "epoch", cut.alias("cut_document"))
