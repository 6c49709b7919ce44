"""Roll-ups from functions to packages, modules and path groups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, scores
from plumbline.schemas import FUNC, MODULE, PACKAGE, SNAP, TYPE
from plumbline.session import settle

GRADES = ["grade_crap", "grade_mutation", "grade_coverage", "grade_combined"]
COUNTS = ["killed", "survived", "not_covered", "timed_out"]
# Worst function: highest CRAP (unmeasured below all), then the lowest
# combined grade (ungraded above all), then the first id.
NO_CRAP, NO_GRADE = -1.0, 11


def _accumulate(m: DataFrame, by: list[str]) -> DataFrame:
    """Unrounded sums, minima and maxima per group; every one of them merges,
    so each task sends one row per group."""
    rank = F.struct(
        (-F.coalesce("crap", F.lit(NO_CRAP))).alias("r"),
        F.coalesce("grade_combined", F.lit(NO_GRADE)).alias("g"),
        F.col("id").alias("id"),
    )
    return m.groupBy(*by).agg(
        *[F.min(g).alias(g) for g in GRADES],
        F.max("crap").alias("crap_max"),
        F.sum("crap").alias("crap_sum"),
        F.count("crap").alias("crap_n"),
        F.min(rank).alias("rank"),
        F.sum("stmts").alias("stmts"),
        F.sum("covered").alias("covered"),
        F.bool_or("coverage_stale").alias("coverage_stale"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.bool_or("mutation_stale").alias("mutation_stale"),
        F.count("*").alias("functions"),
        F.sum((F.coalesce("grade_combined", F.lit(0)) >= scores.GREEN).cast("long")).alias("green"),
    )


def _merge(acc: DataFrame, by: list[str]) -> DataFrame:
    sums = ["crap_sum", "crap_n", "stmts", "covered", *COUNTS, "functions", "green"]
    return acc.groupBy(*by).agg(
        *[F.min(g).alias(g) for g in GRADES],
        F.max("crap_max").alias("crap_max"),
        F.min("rank").alias("rank"),
        *[F.sum(c).alias(c) for c in sums],
        F.bool_or("coverage_stale").alias("coverage_stale"),
        F.bool_or("mutation_stale").alias("mutation_stale"),
    )


def _finish(acc: DataFrame, by: list[str]) -> DataFrame:
    return acc.select(
        *by,
        *GRADES,
        scores.round1(F.col("crap_max")).alias("crap_max"),
        scores.round1(F.col("crap_sum") / F.when(F.col("crap_n") > 0, F.col("crap_n"))).alias("crap_avg"),
        F.col("rank.id").alias("worst"),
        "stmts",
        "covered",
        scores.percent("covered", "stmts").alias("percent"),
        "coverage_stale",
        *COUNTS,
        scores.mutation_score("killed", "timed_out", "survived").alias("score"),
        "mutation_stale",
        "functions",
        "green",
    )


def roll_up(
    metrics: DataFrame,
    nodes: DataFrame,
    directory_churn: DataFrame | None = None,
    coverage_errors: DataFrame | None = None,
    mutation_errors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(packages, modules)``. A package without functions has NULLs; every
    module carries the total over all functions whose parent is a package.

    The module row merges the package rows, so functions are read once.
    """
    acc = _accumulate(metrics.withColumnRenamed("parent", "package"), SNAP + ["package"])
    return _rows(acc, nodes, directory_churn, coverage_errors, mutation_errors)


def _rows(
    acc: DataFrame,
    nodes: DataFrame,
    directory_churn: DataFrame | None,
    coverage_errors: DataFrame | None,
    mutation_errors: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    packages = nodes.where(F.col("kind") == PACKAGE).select(*SNAP, F.col("id").alias("package"), "name", "dir")
    kept = packages.join(acc, SNAP + ["package"], "left")
    out = _finish(kept, SNAP + ["package", "name", "dir"]).withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ["functions", "green"]}
    )
    if directory_churn is not None:
        out = out.join(directory_churn.select("repo", "dir", "churn"), ["repo", "dir"], "left").withColumn(
            "churn", F.coalesce("churn", F.lit(0))
        )
    else:
        out = out.withColumn("churn", F.lit(None).cast("long"))
    for errors, name in [(coverage_errors, "coverage_error"), (mutation_errors, "mutation_error")]:
        if errors is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        else:
            out = out.join(
                errors.select("repo", "package", F.col("error").alias(name)), ["repo", "package"], "left"
            )
    total = _finish(_merge(acc.join(packages, SNAP + ["package"], "left_semi"), SNAP), SNAP)
    modules = (
        nodes.where(F.col("kind") == MODULE)
        .select(*SNAP, F.col("id").alias("module"))
        .join(total, SNAP, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ["functions", "green"]})
    )
    return out, modules


class RollUpState(NamedTuple):
    """Accumulated functions of one snapshot a repository, to be stored and renewed:
    ``slices`` (``repo, package, slice, …``, a slice being a share of a package's ids
    by hash) and ``packages`` (``repo, package, …``)."""

    slices: DataFrame
    packages: DataFrame


# Slices of a package; a change renews those it touches, whatever the package's size.
SLICES = 16


def _in_slices(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("parent", "package").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))


def start_state(metrics: DataFrame) -> RollUpState:
    """The state of a snapshot that has none yet; functions without a package are left out."""
    slices = settle(_accumulate(_in_slices(metrics.where("parent is not null")), ["repo", "package", "slice"]), "rollup-slices")
    return RollUpState(slices, settle(_merge(slices, ["repo", "package"]), "rollup-packages"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a roll-up must renew (``repo, parent, id``): functions that appeared, vanished, changed
    in a measured value, or moved, which lists the package they left as well."""
    columns = [*GRADES, "crap", "stmts", "covered", "coverage_stale", *COUNTS, "mutation_stale"]
    key = ["repo", "parent", "id"]

    def digests(rows: DataFrame, sign: int) -> DataFrame:
        # struct fields keep their place in the text, so that NULLs are told apart
        digest = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(20,0)")
        return rows.select(*key, digest.alias("digest"), F.lit(sign).alias("sign"))

    return (
        digests(before, -1)
        .unionByName(digests(after, 1))
        .groupBy(*key)
        .agg(F.sum(F.col("digest") * F.col("sign")).alias("digest"), F.sum("sign").alias("n"))
        .where("digest <> 0 or n <> 0")
        .select(*key)
    )


def change_state(state: RollUpState, metrics: DataFrame, changes: DataFrame) -> RollUpState:
    """The state after a change, from the state before it.

    ``changes`` (``repo, parent, id``) lists functions that changed, appeared or vanished, with
    the package each was in and is in. The slices they are in are accumulated anew from ``metrics``,
    packages with such a slice are merged anew, and all else is taken over. Nothing is
    subtracted, so extremes that vanish and sums of decimals are as exact as from scratch.
    """
    touched = settle(_in_slices(changes.where("parent is not null")).select("repo", "package", "slice").distinct(), "rollup-touched")
    key = ["repo", "package", "slice"]
    fresh = _accumulate(_in_slices(metrics.where("parent is not null")).join(touched, key, "left_semi"), key)
    slices = settle(state.slices.join(touched, key, "left_anti").unionByName(fresh), "rollup-slices")
    some = touched.select("repo", "package").distinct()
    merged = _merge(slices.join(some, ["repo", "package"], "left_semi"), ["repo", "package"])
    return RollUpState(slices, settle(state.packages.join(some, ["repo", "package"], "left_anti").unionByName(merged), "rollup-packages"))


def roll_up_state(
    state: RollUpState,
    nodes: DataFrame,
    directory_churn: DataFrame | None = None,
    coverage_errors: DataFrame | None = None,
    mutation_errors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(packages, modules)`` as ``roll_up`` gives them, of a state and its snapshot's nodes."""
    snapshots = nodes.select(*SNAP).distinct()
    return _rows(state.packages.join(snapshots, "repo"), nodes, directory_churn, coverage_errors, mutation_errors)


def group_roll_up(packages: DataFrame, groups: DataFrame) -> DataFrame:
    """Packages to path groups (``repo, snapshot_id, package, prefix``): worst
    grades, highest CRAP and its function (first package on ties)."""
    top = F.min(
        F.when(
            F.col("crap_max").isNotNull(),
            F.struct((-F.col("crap_max")).alias("r"), F.col("package"), F.col("worst").alias("worst")),
        )
    )
    return (
        packages.join(groups.select(*SNAP, "package", "prefix"), SNAP + ["package"])
        .groupBy(*SNAP, "prefix")
        .agg(
            *[F.min(g).alias(g) for g in GRADES],
            F.max("crap_max").alias("crap_max"),
            top.alias("_t"),
            F.count("*").alias("packages"),
        )
        .withColumn("worst", F.col("_t.worst"))
        .drop("_t")
    )


def green_share(rolled: DataFrame) -> DataFrame:
    """``green``, ``functions`` and the floored share; no row without functions."""
    return rolled.where("functions > 0").withColumn(
        "green_percent", F.floor(F.col("green") * 100 / F.col("functions"))
    )


def scan_summary(nodes: DataFrame) -> DataFrame:
    """Packages, functions, types and package errors per snapshot."""

    def n(kind: str):
        return F.count_if(F.col("kind") == kind)

    errors = F.when(F.col("kind") == PACKAGE, F.coalesce(F.size("errors"), F.lit(0))).otherwise(0)
    errors = F.when(errors < 0, 0).otherwise(errors)
    return nodes.groupBy(*SNAP).agg(
        n(PACKAGE).alias("packages"),
        n(FUNC).alias("functions"),
        n(TYPE).alias("types"),
        F.sum(errors).cast("long").alias("package_errors"),
    )


def package_error_lines(nodes: DataFrame) -> DataFrame:
    """One ``name: message`` row per package error."""
    return (
        nodes.where(F.col("kind") == PACKAGE)
        .select(*SNAP, "id", "name", F.posexplode("errors").alias("ord", "message"))
        .select(*SNAP, "id", "ord", F.concat("name", F.lit(": "), "message").alias("error"))
    )


def graph_counts(nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Number of nodes, edges and metrics entries per snapshot."""

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*SNAP).agg(F.count("*").alias("n")).withColumn("what", F.lit(name))

    parts = n(nodes, "nodes").unionByName(n(edges, "edges")).unionByName(n(metrics, "metrics"))
    return parts.groupBy(*SNAP).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w)
            for w in ["nodes", "edges", "metrics"]
        ]
    )


def package_purity(nodes: DataFrame, purity: DataFrame) -> DataFrame:
    """A package is pure when all its functions are (none: pure)."""
    flags = (
        nodes.where(F.col("kind") == FUNC)
        .select(*SNAP, "id", F.col("parent").alias("package"))
        .join(purity.select(*SNAP, "id", "pure"), SNAP + ["id"])
        .groupBy(*SNAP, "package")
        .agg(F.bool_and("pure").alias("pure"))
    )
    return (
        nodes.where(F.col("kind") == PACKAGE)
        .select(*SNAP, F.col("id").alias("package"))
        .join(flags, SNAP + ["package"], "left")
        .withColumn("pure", F.coalesce("pure", F.lit(True)))
    )


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("repo").agg(F.max("ran_at").alias("ran_at"))


def overview(packages: DataFrame, purity: DataFrame) -> DataFrame:
    """One row per package for an overview: grades, risk, scores, problems."""
    return packages.join(purity, SNAP + ["package"], "left").select(
        *SNAP,
        "package",
        "name",
        F.coalesce("pure", F.lit(False)).alias("pure"),
        *GRADES,
        "crap_max",
        "percent",
        "score",
        paths.short("worst").alias("riskiest"),
        F.filter(
            F.array("coverage_error", "mutation_error"), lambda e: e.isNotNull() & (e != "")
        ).alias("problems"),
    )


def outside_calls(nodes: DataFrame, edges: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Functions of other packages that a package's (shown) functions call:
    one row per pair of packages and called function."""
    f = nodes.where(F.col("kind") == FUNC).select(*SNAP, "id", F.col("parent").alias("pkg"))
    src = f if shown is None else f.join(shown.select(*SNAP, "id"), SNAP + ["id"], "left_semi")
    calls = edges.where(F.col("kind").isin("calls", "calls_dynamic")).select(*SNAP, "from", "to").distinct()
    return (
        calls.join(src.select(*SNAP, F.col("id").alias("from"), F.col("pkg").alias("from_package")), SNAP + ["from"])
        .join(f.select(*SNAP, F.col("id").alias("to"), F.col("pkg").alias("to_package")), SNAP + ["to"])
        .where("to_package IS NOT NULL AND from_package <> to_package")
        .select(*SNAP, "from_package", "to_package", F.col("to").alias("function"))
        .distinct()
    )


def outside_counts(outside: DataFrame) -> DataFrame:
    return outside.groupBy(*SNAP, "from_package", "to_package").agg(F.count("*").alias("functions"))
