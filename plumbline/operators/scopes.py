"""Scopes and node-level projections: which functions a job looks at."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions.paths import glob_regex
from plumbline.operators.intervals import lines_of, touched_functions
from plumbline.operators.ordered import running_total
from plumbline.schemas import CALLS_DYNAMIC, EXTERNAL, FUNC, IMPORTS, PACKAGE, SNAP
from plumbline.session import settle

ID = SNAP + ["id"]


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def functions(nodes: DataFrame) -> DataFrame:
    return of_kind(nodes, FUNC)


def packages(nodes: DataFrame) -> DataFrame:
    return of_kind(nodes, PACKAGE)


def excluded(rows: DataFrame, patterns: list[str], column: str = "file") -> DataFrame:
    """Rows whose path matches none of the globs."""
    return rows.where(~paths.matches_glob(column, patterns))


def _regex_column(pattern: Column) -> Column:
    @F.pandas_udf("string")
    def compiled(p: pd.Series) -> pd.Series:
        return p.map(glob_regex)

    return compiled(pattern)


def files_matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``repo, file`` pairs matched by any glob of the same repository.

    ``patterns``: ``repo, pattern``. Only the pattern table is compiled row by
    row, and written first, or the optimizer compiles a pattern for every row it
    came from; the match itself is a semi join on the repository.
    """
    known = settle(patterns.select("repo", "pattern").distinct(), "patterns")
    rx = known.select(F.col("repo").alias("_repo"), _regex_column(F.col("pattern")).alias("_rx"))
    f = files.select("repo", "file").distinct()
    return f.join(rx, (f["repo"] == rx["_repo"]) & F.expr("file rlike _rx"), "left_semi")


def in_files(funcs: DataFrame, files: DataFrame) -> DataFrame:
    """Functions declared in the given files (``repo, file``)."""
    return funcs.join(files.select("repo", "file"), ["repo", "file"], "left_semi").select(*ID)


def changed(funcs: DataFrame, hunks: DataFrame, untracked: DataFrame) -> DataFrame:
    """Functions a hunk touches, and all functions of untracked files."""
    return touched_functions(funcs, hunks).unionByName(in_files(funcs, untracked)).distinct()


def expand(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Function ids stay, package ids become their functions, others drop out."""
    f = functions(nodes).select(*ID, "parent")
    wanted = ids.select(*ID).distinct()
    pk = packages(nodes).select(*ID).join(wanted, ID, "left_semi").withColumnRenamed("id", "parent")
    return (
        f.join(wanted, ID, "left_semi")
        .select(*ID)
        .unionByName(f.join(pk, SNAP + ["parent"], "left_semi").select(*ID))
        .distinct()
    )


def packages_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Packages that hold the given nodes; a package is its own."""
    pkg = F.when(F.col("kind") == PACKAGE, F.col("id")).otherwise(F.col("parent"))
    return (
        nodes.join(ids.select(*ID), ID, "left_semi")
        .select(*SNAP, pkg.alias("package"))
        .where("package IS NOT NULL AND package <> ''")
        .distinct()
    )


def with_loc(spans: DataFrame) -> DataFrame:
    return spans.withColumn("loc", F.col("end_line") - F.col("line") + 1)


def with_effective_thresholds(repos: DataFrame, thresholds: DataFrame | None, defaults: dict | None = None) -> DataFrame:
    """One row of limits per repository: its own where set, else the defaults."""
    d = DEFAULT_THRESHOLDS | (defaults or {})
    out = repos.select("repo").distinct()
    if thresholds is None:
        return out.withColumns({k: F.lit(v) for k, v in d.items()})
    return out.join(thresholds, "repo", "left").select(
        "repo", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in d.items()]
    )


# Default limits.
DEFAULT_THRESHOLDS = {"crap_max": 8.0, "cognitive_max": 15, "coverage_min": 80.0, "mutation_min": 70.0}


# --- graph hygiene ----------------------------------------------------------


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*SNAP, "from", "to", "kind").distinct()


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist. A dynamic call points at a method that is
    not a node; there the owning type must exist."""
    ids = nodes.select(*ID).distinct()
    target = F.when(F.col("kind") == CALLS_DYNAMIC, paths.method_owner("to")).otherwise(F.col("to"))
    return (
        edges.join(ids.withColumnRenamed("id", "from"), SNAP + ["from"], "left_semi")
        .withColumn("_target", target)
        .join(ids.withColumnRenamed("id", "_target"), SNAP + ["_target"], "left_semi")
        .select(*SNAP, "from", "to", "kind")
    )


def unique_ids(nodes: DataFrame) -> DataFrame:
    """Later nodes with a taken id get ``#file``, then ``#file:line``.

    First means lowest (file, line). Both firsts are plain minima, so an id
    shared by very many nodes needs no ordered group.
    """
    base = F.substring_index("file", "/", -1)
    place = F.struct("file", "line")
    first = nodes.groupBy(*ID).agg(F.min(place).alias("_first"))
    marked = nodes.join(first, ID).withColumn("_is_first", place.eqNullSafe(F.col("_first")))
    rest = (
        marked.where("NOT _is_first")
        .groupBy(*ID, base.alias("_base"))
        .agg(F.min(place).alias("_next"))
    )
    return (
        marked.withColumn("_base", base)
        .join(rest, ID + ["_base"], "left")
        .withColumn(
            "id",
            F.when(F.col("_is_first"), F.col("id"))
            .when(place == F.col("_next"), F.concat("id", F.lit("#"), "_base"))
            .otherwise(F.concat("id", F.lit("#"), "_base", F.lit(":"), F.col("line").cast("string"))),
        )
        .select(nodes.columns)
    )


def external_imports(
    imports: DataFrame,
    module_of: DataFrame,
    external_modules: str = "collapsed",
    show_stdlib: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Imports from outside as ``(nodes, edges)``.

    ``imports``: ``…, importer, path``; ``module_of``: ``path, module`` (NULL
    or absent: standard library). Many packages of one module become one node
    with one edge per importer.
    """
    m = imports.join(module_of.select("path", "module"), "path", "left").withColumn(
        "module", F.when(F.col("module") != "", F.col("module"))
    )
    std = F.col("module").isNull()
    shown = (std & F.lit(show_stdlib)) | (~std & F.lit(external_modules != "hidden"))
    kept = m.where(shown).select(
        *SNAP,
        "importer",
        F.coalesce("module", "path").alias("id"),
        F.coalesce(paths.external_name("module"), F.col("path")).alias("name"),
    )
    ext = kept.select(*ID, "name").distinct().withColumn("kind", F.lit(EXTERNAL))
    edges = kept.select(
        *SNAP, F.col("importer").alias("from"), F.col("id").alias("to"), F.lit(IMPORTS).alias("kind")
    ).distinct()
    return ext, edges


def fingerprints(funcs: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Digest of each function's lines that comments and blank lines do not
    change: ``…, id, body_hash``.

    Each kept line is hashed with its number among the kept ones and the parts
    are combined by XOR, an aggregate that merges in any order, so no function
    body is gathered. Equality is by line text, not by syntax tree.
    """
    inside = lines_of(funcs, source_lines)
    text = paths.strip("text")
    kept = inside.where((text != "") & ~text.startswith("//"))
    numbered = running_total(kept.select(*ID, "n", "text"), ID, "n", F.lit(1), "_k")
    digest = F.sha2(F.concat_ws(":", F.col("_k").cast("string"), F.rtrim("text")), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)]
    combined = numbered.select(*ID, *[p.alias(f"_p{i}") for i, p in enumerate(parts)]).groupBy(*ID).agg(
        F.count("*").alias("_lines"), *[F.bit_xor(f"_p{i}").alias(f"_p{i}") for i in range(4)]
    )
    cols = ["_lines"] + [f"_p{i}" for i in range(4)]
    return combined.select(
        *ID, F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in cols]), 256)).alias("body_hash")
    )

