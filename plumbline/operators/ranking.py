"""Rankings and risk orders.

A top-n is a window rank with a bound, which Spark cuts to n rows per key in
every task before it shuffles; a full order is a range-partitioned sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import paths, scores
from plumbline.schemas import SNAP

ID = SNAP + ["id"]


@dataclass(frozen=True)
class Metric:
    """A rankable metric: its value, whether it is stale, and its direction."""

    value: Column
    stale: Column
    low_is_worse: bool = False


def registry() -> dict[str, Metric]:
    """Built-in metrics; callers add their own entries to the returned dict."""
    fresh = F.lit(False)
    cov = F.coalesce("coverage_stale", fresh)
    mut = F.coalesce("mutation_stale", fresh)
    return {
        "crap": Metric(F.col("crap"), cov),
        "cognitive": Metric(F.col("cognitive").cast("double"), fresh),
        "cc": Metric(F.col("cc").cast("double"), fresh),
        "coverage": Metric(F.col("percent"), cov, low_is_worse=True),
        "mutation": Metric(F.col("score"), mut, low_is_worse=True),
    }


def _lookup(metric: str, metrics: dict[str, Metric] | None) -> Metric:
    known = registry() if metrics is None else metrics
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}; use one of: {', '.join(known)}")
    return known[metric]


def rank_worst(
    m: DataFrame,
    metric: str,
    n: int = 10,
    scope: DataFrame | None = None,
    metrics: dict[str, Metric] | None = None,
) -> DataFrame:
    """The n worst functions of each snapshot, ties by id: ``position, id,
    value, stale``. ``n <= 0`` gives all of them in order, without a position.
    Functions without a value are left out (see :func:`not_measured`)."""
    d = _lookup(metric, metrics)
    rows = m if scope is None else m.join(scope.select(*ID), ID, "left_semi")
    rows = rows.select(*ID, d.value.alias("value"), d.stale.alias("stale")).where("value IS NOT NULL")
    worst = F.col("value").asc() if d.low_is_worse else F.col("value").desc()
    if n <= 0:
        return rows.orderBy(*SNAP, worst, "id")
    w = Window.partitionBy(*SNAP).orderBy(worst, F.col("id"))
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def not_measured(
    m: DataFrame, metric: str, scope: DataFrame | None = None, metrics: dict[str, Metric] | None = None
) -> DataFrame:
    """Functions of each snapshot that have no value for the metric."""
    d = _lookup(metric, metrics)
    rows = m if scope is None else m.join(scope.select(*ID), ID, "left_semi")
    return rows.groupBy(*SNAP).agg(F.count_if(d.value.isNull()).alias("not_measured"))


def by_risk(m: DataFrame) -> DataFrame:
    """Full order by CRAP, highest first, missing last, then id."""
    return m.orderBy(*SNAP, F.col("crap").desc_nulls_last(), "id")


def riskiest_in_scope(m: DataFrame, shown: int = 15) -> DataFrame:
    """The first ``shown`` of each snapshot in risk order, each with the
    number ``more`` that follow."""
    w = Window.partitionBy(*SNAP).orderBy(F.col("crap").desc_nulls_last(), "id")
    top = m.select(*ID, "crap").withColumn("position", F.row_number().over(w)).where(F.col("position") <= shown)
    size = m.groupBy(*SNAP).agg(F.count("*").alias("_n"))
    return top.join(size, SNAP).select(
        *ID, "crap", "position", F.greatest(F.col("_n") - shown, F.lit(0)).alias("more")
    )


def map_order(m: DataFrame, shown: int = 40) -> DataFrame:
    """The functions a package box shows: missing CRAP first, then highest,
    then name in binary order (id last); plus ``more`` for those cut."""
    key = SNAP + ["parent"]
    w = Window.partitionBy(*key).orderBy(F.col("crap").desc_nulls_first(), "name", "id")
    top = m.withColumn("position", F.row_number().over(w)).where(F.col("position") <= shown)
    size = m.groupBy(*key).agg(F.count("*").alias("_n"))
    return top.join(size, key).withColumn("more", F.greatest(F.col("_n") - shown, F.lit(0))).drop("_n")


def riskiest(m: DataFrame, n: int = 3) -> DataFrame:
    """The n riskiest functions of each package with a one-line reason."""
    survived = F.coalesce("survived", F.lit(0))
    reason = (
        F.when(F.col("crap").isNull(), F.lit("coverage not measured"))
        .when(scores.untested("percent", "stmts"), F.lit("no tests run it"))
        .when(survived > 0, F.concat(survived.cast("string"), F.lit(" mutants survived")))
        .otherwise(F.concat(F.lit("CC "), F.coalesce(F.col("cc").cast("string"), F.lit("—"))))
    )
    return map_order(m, n).select(
        *SNAP,
        "parent",
        "position",
        "id",
        "name",
        "crap",
        F.coalesce("grade_crap", F.lit(1)).alias("grade"),
        reason.alias("reason"),
    )


def first_in_map_order(m: DataFrame, condition: Column) -> DataFrame:
    """The first function of each package in map order that meets a condition:
    ``…, parent, id, name`` (an aggregate, so no rank is computed)."""
    order = F.struct(
        F.col("crap").isNotNull().alias("known"), (-F.col("crap")).alias("r"), F.col("name"), F.col("id")
    )
    return (
        m.where(condition)
        .groupBy(*SNAP, "parent")
        .agg(F.min(order).alias("_f"))
        .select(*SNAP, "parent", F.col("_f.id").alias("id"), F.col("_f.name").alias("name"))
    )


def fixed1(v: Column) -> Column:
    return F.format_string("%.1f", v)


def package_problems(
    packages: DataFrame, m: DataFrame, thresholds: DataFrame, shown: int = 2
) -> DataFrame:
    """The first problems of each package, most urgent first: ``ord, text,
    tone``. ``packages`` is a roll-up; ``thresholds`` has one row per repo."""
    bare = first_in_map_order(m, scores.untested("percent", "stmts")).select(
        *SNAP, F.col("parent").alias("package"), F.col("id").alias("_bare"), F.col("name").alias("_bare_name")
    )
    names = m.select(*SNAP, F.col("id").alias("worst"), F.col("name").alias("_worst_name"))
    p = (
        packages.join(bare, SNAP + ["package"], "left")
        .join(names, SNAP + ["worst"], "left")
        .join(thresholds.select("repo", F.col("crap_max").alias("_crap"), F.col("mutation_min").alias("_mut")), "repo")
    )

    def item(cond: Column, text: Column, tone: str) -> Column:
        return F.when(cond, F.struct(text.alias("text"), F.lit(tone).alias("tone")))

    unmeasured = F.col("killed").isNull()
    found = F.array(
        item(F.coalesce(F.col("coverage_error"), F.lit("")) != "", F.lit("tests failed: coverage not measured"), "red"),
        item(F.coalesce(F.col("mutation_error"), F.lit("")) != "", F.lit("tests fail: mutation not run"), "red"),
        item(F.col("_bare").isNotNull(), F.concat("_bare_name", F.lit(" has no tests")), "red"),
        item(
            (F.col("score") < F.col("_mut")) & (F.col("survived") > 0),
            F.concat(F.col("survived").cast("string"), F.lit(" mutants survived")),
            "orange",
        ),
        item(
            (F.col("crap_max") > F.col("_crap")) & F.col("worst").isNotNull() & ~F.col("_bare").eqNullSafe(F.col("worst")),
            F.concat(
                F.coalesce("_worst_name", paths.short("worst")), F.lit(" · CRAP "), fixed1(F.col("crap_max"))
            ),
            "orange",
        ),
        item(unmeasured & (F.col("functions") > 0), F.lit("mutation not measured yet"), "red"),
    )
    top = F.slice(F.array_compact(found), 1, shown)
    return p.select(*SNAP, "package", F.posexplode(top).alias("ord", "_p")).select(
        *SNAP, "package", "ord", F.col("_p.text").alias("text"), F.col("_p.tone").alias("tone")
    )


def function_chips(m: DataFrame, thresholds: DataFrame, shown: int = 3) -> DataFrame:
    """Problem chips of each function: ``ord, text, tone`` (``grade:<n>`` for
    a tone that follows the CRAP grade)."""
    survived = F.coalesce("survived", F.lit(0))

    def item(cond: Column, text: Column, tone: Column) -> Column:
        return F.when(cond, F.struct(text.alias("text"), tone.alias("tone")))

    p = m.join(thresholds.select("repo", F.col("crap_max").alias("_crap")), "repo")
    found = F.array(
        item(scores.untested("percent", "stmts"), F.lit("untested"), F.lit("red")),
        item(
            F.col("crap") > F.col("_crap"),
            F.concat(F.lit("CRAP "), fixed1(F.col("crap"))),
            F.concat(F.lit("grade:"), F.coalesce("grade_crap", F.lit(1)).cast("string")),
        ),
        item(
            survived > 0,
            F.concat(survived.cast("string"), F.lit(" survived")),
            F.when(survived > 2, F.lit("red")).otherwise(F.lit("yellow")),
        ),
    )
    top = F.slice(F.array_compact(found), 1, shown)
    return p.select(*ID, F.posexplode(top).alias("ord", "_p")).select(
        *ID, "ord", F.col("_p.text").alias("text"), F.col("_p.tone").alias("tone")
    )


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key, with their ``position``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
