"""Validation of graphs from outside, and how a valid one is merged.

Rows of an external graph carry ``source`` (who delivered it) and ``i``, the
position in its list, so that every problem names its JSON path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.schemas import EDGE_KINDS, FUNC, NODE_FIELDS, NODE_KINDS, PACKAGE, SNAP, TYPE, METRICS_JSON

KEY = SNAP + ["source"]
NODE_NAMES = [n for n, _ in NODE_FIELDS]
METRIC_NAMES = METRICS_JSON.fieldNames()


def _problem(rows: DataFrame, bad: Column, path: Column, message: str) -> DataFrame:
    return rows.where(bad).select(*KEY, path.alias("path"), F.lit(message).alias("message"))


def _at(lst: str, field: str = "") -> Column:
    return F.concat(F.lit(f"$.{lst}["), F.col("i").cast("string"), F.lit("]" + field))


def _metric(field: str = "") -> Column:
    return F.concat(F.lit('$.metrics["'), F.col("id"), F.lit('"]' + field))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _per_row(rows: DataFrame, rules: list[tuple[Column, Column, str]]) -> DataFrame:
    """All row-wise rules in one pass over the rows."""
    found = [F.when(bad, F.struct(p.alias("path"), F.lit(msg).alias("message"))) for bad, p, msg in rules]
    return rows.select(*KEY, F.explode(F.array_compact(F.array(*found))).alias("_p")).select(*KEY, "_p.*")


def problems(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per broken rule: ``…, source, path, message``.

    ``nodes``: node columns plus ``source, i, keys``; ``edges``: ``source, i,
    from, to, kind``; ``metrics``: ``source, id, keys, cc, stmts, covered,
    percent, score``; ``existing``: ids already in the snapshot. ``keys`` are
    the JSON field names that were given.
    """
    spans = F.col("kind").isin(FUNC, TYPE)
    file_parts = F.split("file", "/")
    bad_file = _blank("file") | F.col("file").startswith("/") | F.array_contains(file_parts, "..")
    line = F.coalesce("line", F.lit(0))

    def unknown(names: list[str]) -> Column:
        return F.size(F.array_except("keys", F.array(*[F.lit(n) for n in names]))) > 0

    node_rules = _per_row(
        nodes,
        [
            (unknown(NODE_NAMES), _at("nodes"), "unknown field"),
            (_blank("id"), _at("nodes", ".id"), "required"),
            (~F.coalesce(F.col("kind").isin(NODE_KINDS), F.lit(False)), _at("nodes", ".kind"), "unknown kind"),
            (_blank("name"), _at("nodes", ".name"), "required"),
            (spans & bad_file, _at("nodes", ".file"), "must be relative to the root"),
            (spans & (line < 1), _at("nodes", ".line"), "must be at least 1"),
            (
                (F.col("kind") == FUNC) & (F.coalesce("end_line", F.lit(0)) < line),
                _at("nodes", ".end_line"),
                "must not be before line",
            ),
        ],
    )
    ids = nodes.where(~_blank("id"))
    first = ids.groupBy(*KEY, "id").agg(F.min("i").alias("_first"))
    dup = ids.join(first, KEY + ["id"]).where("i > _first")
    twice = _problem(dup, F.lit(True), _at("nodes", ".id"), "not unique")
    clash = _problem(
        ids.join(existing.select(*SNAP, "id").distinct(), SNAP + ["id"], "left_semi"),
        F.lit(True),
        _at("nodes", ".id"),
        "already used by another graph",
    )
    known = first.select(*KEY, "id")

    def missing(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(~_blank(column)).join(known.withColumnRenamed("id", column), KEY + [column], "left_anti")

    orphan = _problem(missing(nodes, "parent"), F.lit(True), _at("nodes", ".parent"), "no such node")
    edge_rules = _per_row(
        edges,
        [
            (~F.coalesce(F.col("kind").isin(EDGE_KINDS), F.lit(False)), _at("edges", ".kind"), "unknown kind"),
            (_blank("from"), _at("edges", ".from"), "no such node"),
            (_blank("to"), _at("edges", ".to"), "no such node"),
        ],
    )
    from_ = _problem(missing(edges, "from"), F.lit(True), _at("edges", ".from"), "no such node")
    to = _problem(missing(edges, "to"), F.lit(True), _at("edges", ".to"), "no such node")
    stray = _problem(missing(metrics, "id"), F.lit(True), _metric(), "no such node")
    outside = (F.col("percent") < 0) | (F.col("percent") > 100)
    metric_rules = _per_row(
        metrics,
        [
            (unknown(METRIC_NAMES), _metric(), "unknown field"),
            (F.col("cc") < 1, _metric(".cc"), "must be at least 1"),
            (F.col("covered") > F.col("stmts"), _metric(".coverage.covered"), "must not exceed stmts"),
            (outside, _metric(".coverage.percent"), "must be within 0 and 100"),
            ((F.col("score") < 0) | (F.col("score") > 100), _metric(".mutation.score"), "must be within 0 and 100"),
        ],
    )
    out = node_rules
    for part in [twice, clash, orphan, edge_rules, from_, to, stray, metric_rules]:
        out = out.unionByName(part)
    return out


def failed_sources(found: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Sources that may not be merged, each with its number of problems and a
    reason: ``…, source, problems, reason``. ``unreadable``: ``…, source``."""
    broken = found.groupBy(*KEY).agg(F.count("*").alias("problems"))
    out = broken.withColumn(
        "reason",
        F.concat(
            F.lit("provider "),
            F.col("source"),
            F.lit(" broke the contract ("),
            F.col("problems").cast("string"),
            F.lit(" problems); its language is not measured"),
        ),
    )
    if unreadable is None:
        return out
    lost = unreadable.select(*KEY).distinct().select(
        *KEY,
        F.lit(0).cast("long").alias("problems"),
        F.concat(F.lit("provider "), F.col("source"), F.lit(": not a graph; its language is not measured")).alias(
            "reason"
        ),
    )
    return out.unionByName(lost)


def not_measured_packages(failed: DataFrame, modules: DataFrame) -> DataFrame:
    """The package row that stands for a failed source: its reason as error."""
    return failed.join(modules.select(*SNAP, F.col("id").alias("parent")), SNAP, "left").select(
        *SNAP,
        F.concat(F.lit("provider:"), F.col("source")).alias("id"),
        F.lit(PACKAGE).alias("kind"),
        F.concat("source", F.lit(" (not measured)")).alias("name"),
        "parent",
        F.array("reason").alias("errors"),
    )


def merged_nodes(nodes: DataFrame, failed: DataFrame, modules: DataFrame) -> DataFrame:
    """Nodes of valid sources as they join the snapshot.

    Packages without a parent go under the module. A function is pure only
    when its source says so; otherwise it is effectful, with the given effects
    or the reason that its purity is not known.
    """
    ok = nodes.join(failed.select(*KEY), KEY, "left_anti")
    top = modules.groupBy(*SNAP).agg(F.min("id").alias("_module"))
    is_func = F.col("kind") == FUNC
    pure = F.coalesce("pure", F.lit(False))
    unknown = F.array(F.concat(F.lit("purity not known (from provider "), F.col("source"), F.lit(")")))
    given = F.coalesce(F.size("effects"), F.lit(0)) > 0
    return (
        ok.join(top, SNAP, "left")
        .withColumn(
            "parent",
            F.when((F.col("kind") == PACKAGE) & _blank("parent"), F.col("_module")).otherwise(F.col("parent")),
        )
        .withColumn(
            "effects",
            F.when(~is_func | pure, F.col("effects")).when(given, F.col("effects")).otherwise(unknown),
        )
        .withColumn("pure", F.when(is_func, pure).otherwise(F.col("pure")))
        .select(*SNAP, *NODE_NAMES)
    )
