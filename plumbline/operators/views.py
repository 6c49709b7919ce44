"""What a map or a detail page shows of the graph, for all nodes at once.

Lists are rows, not arrays: a function that a third of the code calls has as
many neighbour rows as callers, spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions.text import range_text
from plumbline.operators.coverage import state_runs
from plumbline.operators.ranking import map_order
from plumbline.operators.rollup import outside_calls
from plumbline.schemas import CALLS, CALLS_DYNAMIC, EXTERNAL, FUNC, IMPLEMENTS, IMPORTS, MODULE, PACKAGE, SNAP, TYPE

ID = SNAP + ["id"]
# Most packages a view shows before it groups them.
MAX_PACKAGES = 25
GROUP = "group:"


def _relation(kind: Column, forward: bool) -> Column:
    calls = kind.isin(CALLS, CALLS_DYNAMIC)
    names = ("callees", "imports", "implements") if forward else ("callers", "imported_by", "implemented_by")
    return F.when(calls, names[0]).when(kind == IMPORTS, names[1]).when(kind == IMPLEMENTS, names[2])


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All relations of every node: ``…, id, relation, other``.

    Relations are callers, callees, imports, imported_by, implements,
    implemented_by, children and methods. A pair linked by both call kinds
    has two rows.
    """
    ids = nodes.select(*ID)
    k = F.col("kind")
    out = edges.select(*SNAP, F.col("from").alias("id"), _relation(k, True).alias("relation"), F.col("to").alias("other"))
    into = edges.select(*SNAP, F.col("to").alias("id"), _relation(k, False).alias("relation"), F.col("from").alias("other"))
    linked = out.unionByName(into).where("relation IS NOT NULL").join(ids, ID, "left_semi")
    kids = (
        nodes.where("parent IS NOT NULL AND parent <> ''")
        .select(*SNAP, F.col("parent").alias("id"), F.lit("children").alias("relation"), F.col("id").alias("other"))
        .join(ids, ID, "left_semi")
    )
    types = nodes.where(F.col("kind") == TYPE).select(*ID, "parent", F.col("name").alias("recv"))
    methods = (
        nodes.where(F.col("kind") == FUNC)
        .select(*SNAP, "parent", "recv", F.col("id").alias("other"))
        .join(types, SNAP + ["parent", "recv"])
        .select(*ID, F.lit("methods").alias("relation"), "other")
    )
    return linked.unionByName(kids).unionByName(methods)


RELATIONS = ["callers", "callees", "imports", "imported_by", "implements", "implemented_by", "children", "methods"]


def neighbour_counts(nodes: DataFrame, neighbour_rows: DataFrame) -> DataFrame:
    """Number of neighbours of each relation, zero included."""
    n = neighbour_rows.groupBy(*ID).agg(
        *[F.count_if(F.col("relation") == r).alias(r) for r in RELATIONS]
    )
    return nodes.select(*ID, "kind").join(n, ID, "left").withColumns({r: F.coalesce(r, F.lit(0)) for r in RELATIONS})


def function_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct callers and callees of each function that are functions."""
    f = nodes.where(F.col("kind") == FUNC).select(*ID)
    calls = (
        edges.where(F.col("kind").isin(CALLS, CALLS_DYNAMIC))
        .select(*SNAP, "from", "to")
        .distinct()
        .join(f.withColumnRenamed("id", "from"), SNAP + ["from"], "left_semi")
        .join(f.withColumnRenamed("id", "to"), SNAP + ["to"], "left_semi")
    )
    return calls.select(*SNAP, F.col("from").alias("id"), F.lit("callees").alias("relation"), F.col("to").alias("other")).unionByName(
        calls.select(*SNAP, F.col("to").alias("id"), F.lit("callers").alias("relation"), F.col("from").alias("other"))
    )


def type_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods, implements and implemented_by of each type."""
    t = nodes.where(F.col("kind") == TYPE).select(*ID)
    wanted = F.col("relation").isin("methods", "implements", "implemented_by")
    return neighbours(nodes, edges).where(wanted).join(t, ID, "left_semi")


def package_of(nodes: DataFrame) -> DataFrame:
    """The package of every node that has one; a package is its own."""
    pk = nodes.where(F.col("kind") == PACKAGE).select(*SNAP, F.col("id").alias("package")).distinct()
    own = F.when(F.col("kind") == PACKAGE, F.col("id")).otherwise(F.col("parent"))
    return nodes.select(*ID, own.alias("package")).join(pk, SNAP + ["package"], "left_semi").select(*ID, "package")


def worst_package(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """The package of each module's worst function, else the first package."""
    first = nodes.where(F.col("kind") == PACKAGE).groupBy(*SNAP).agg(F.min("id").alias("_first"))
    of = package_of(nodes).select(*SNAP, F.col("id").alias("worst"), "package")
    return (
        nodes.where(F.col("kind") == MODULE)
        .select(*SNAP, F.col("id").alias("module"))
        .join(modules.select(*SNAP, "module", "worst"), SNAP + ["module"], "left")
        .join(of, SNAP + ["worst"], "left")
        .join(first, SNAP, "left")
        .select(*SNAP, "module", F.coalesce("package", "_first").alias("package"))
    )


def boxes(nodes: DataFrame, prefix: str = "", limit: int = MAX_PACKAGES) -> DataFrame:
    """The box each package under ``prefix`` is drawn in: ``…, package, box,
    group_prefix``. Above ``limit`` packages they are grouped by their next
    path segment; a group of one is just that package."""
    pk = nodes.where(F.col("kind") == PACKAGE).select(*SNAP, F.col("id").alias("package"), "name")
    if prefix:
        pk = pk.where((F.col("name") == prefix) | F.col("name").startswith(prefix + "/"))
    rest = F.expr(f"substring(name, {len(prefix) + 2})") if prefix else F.col("name")
    seg = F.substring_index(rest, "/", 1)
    group = F.concat(F.lit(prefix + "/"), seg) if prefix else seg
    pk = pk.withColumn("_g", F.when(F.col("name") != prefix, group) if prefix else group)
    total = pk.groupBy(*SNAP).agg(F.count("*").alias("_total"))
    size = pk.groupBy(*SNAP, "_g").agg(F.count("*").alias("_size"))
    grouped = F.col("_g").isNotNull() & (F.col("_total") > limit) & (F.col("_size") > 1)
    return (
        pk.join(total, SNAP)
        .join(size, SNAP + ["_g"], "left")
        .select(
            *SNAP,
            "package",
            F.when(grouped, F.concat(F.lit(GROUP), "_g")).otherwise(F.col("package")).alias("box"),
            F.when(grouped, F.col("_g")).alias("group_prefix"),
        )
    )


def module_view(nodes: DataFrame, edges: DataFrame, prefix: str = "", limit: int = MAX_PACKAGES) -> DataFrame:
    """Import arrows between boxes: ``…, from, to, external``, one per pair.

    Imports inside a box are dropped; imports of external modules point at
    the module itself. Distinct package pairs are collapsed before they meet
    the box table.
    """
    box = boxes(nodes, prefix, limit).select(*SNAP, "package", "box")
    ext = nodes.where(F.col("kind") == EXTERNAL).select(*SNAP, F.col("id").alias("to"), F.lit(True).alias("_ext")).distinct()
    imp = edges.where(F.col("kind") == IMPORTS).select(*SNAP, "from", "to").distinct()
    return (
        imp.join(box.select(*SNAP, F.col("package").alias("from"), F.col("box").alias("_from")), SNAP + ["from"])
        .join(box.select(*SNAP, F.col("package").alias("to"), F.col("box").alias("_to")), SNAP + ["to"], "left")
        .join(ext, SNAP + ["to"], "left")
        .withColumn("_dest", F.coalesce("_to", F.when(F.col("_ext"), F.col("to"))))
        .where("_dest IS NOT NULL AND _dest <> _from")
        .select(*SNAP, F.col("_from").alias("from"), F.col("_dest").alias("to"), F.col("_to").isNull().alias("external"))
        .distinct()
    )


def package_view(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, expanded: bool = False, shown: int = 40) -> DataFrame:
    """Arrows of every package page: ``…, package, from, to, arrow``.

    ``arrow`` is ``call`` between two shown functions of the package, or
    ``outside`` from a shown function to another package it calls into.
    """
    f = nodes.where(F.col("kind") == FUNC).select(*ID, F.col("parent").alias("package"))
    if expanded:
        vis = f
    else:
        vis = map_order(metrics.select(*ID, "parent", "name", "crap"), shown).select(
            *ID, F.col("parent").alias("package")
        )
    calls = edges.where(F.col("kind").isin(CALLS, CALLS_DYNAMIC)).select(*SNAP, "from", "to").distinct()
    src = vis.select(*SNAP, F.col("id").alias("from"), "package")
    dst = f.select(*SNAP, F.col("id").alias("to"), F.col("package").alias("_to_package"))
    seen = vis.select(*SNAP, F.col("id").alias("to"), F.lit(True).alias("_shown"))
    c = calls.join(src, SNAP + ["from"]).join(dst, SNAP + ["to"])
    inner = (
        c.where("_to_package = package")
        .join(seen, SNAP + ["to"], "left_semi")
        .select(*SNAP, "package", "from", "to", F.lit("call").alias("arrow"))
    )
    outer = c.where("_to_package <> package").select(
        *SNAP, "package", "from", F.col("_to_package").alias("to"), F.lit("outside").alias("arrow")
    )
    return inner.unionByName(outer.distinct())


def shown_outside(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, shown: int = 40) -> DataFrame:
    """Called functions of other packages, from shown functions only."""
    return outside_calls(nodes, edges, map_order(metrics.select(*ID, "parent", "name", "crap"), shown))


def home_group(nodes: DataFrame, limit: int = MAX_PACKAGES) -> DataFrame:
    """The shallowest prefix whose view shows a package as its own box:
    ``…, package, prefix`` (NULL: the top level).

    A package is its own box under a prefix when the prefix holds at most
    ``limit`` packages, equals its name, or gives it a segment of its own.
    """
    pk = nodes.where(F.col("kind") == PACKAGE).select(*SNAP, F.col("id").alias("package"), "name")
    parts = F.split("name", "/")
    levels = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.struct(
            i.alias("depth"),
            F.array_join(F.slice(parts, 1, i), "/").alias("prefix"),
            F.array_join(F.slice(parts, 1, i + 1), "/").alias("group"),
        ),
    )
    at = pk.select(*SNAP, "package", "name", F.explode(levels).alias("_l")).select(*SNAP, "package", "name", "_l.*")
    # Every package counts under each of its own prefixes; one whose name is
    # a prefix counts there as well.
    under = pk.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    totals = under.groupBy(*SNAP, "prefix").agg(F.count("*").alias("_total"))
    sizes = totals.select(*SNAP, F.col("prefix").alias("group"), F.col("_total").alias("_size"))
    own = (
        at.join(totals, SNAP + ["prefix"])
        .join(sizes, SNAP + ["group"])
        .where((F.col("_total") <= limit) | (F.col("_size") == 1))
        .groupBy(*SNAP, "package")
        .agg(F.min_by("prefix", "depth").alias("prefix"))
    )
    return pk.select(*SNAP, "package").join(own, SNAP + ["package"], "left").withColumn(
        "prefix", F.when(F.col("prefix") != "", F.col("prefix"))
    )


SCORES = [
    "crap",
    "crap_max",
    "crap_avg",
    "worst",
    "cc",
    "cognitive",
    "percent",
    "coverage_stale",
    "score",
    "mutation_stale",
    "killed",
    "survived",
    "not_covered",
    "churn",
    "grade_crap",
    "grade_mutation",
    "grade_coverage",
    "grade_combined",
    "coverage_error",
    "mutation_error",
]


def node_view(
    nodes: DataFrame,
    metrics: DataFrame,
    thresholds: DataFrame,
    packages: DataFrame | None = None,
    modules: DataFrame | None = None,
) -> DataFrame:
    """Scores of every node beside the limits of its repository: of functions
    from ``metrics``, of packages and modules from their roll-ups."""
    lines = F.when(
        F.col("line") > 0, F.concat_ws("-", F.col("line"), F.greatest("line", F.coalesce("end_line", "line")))
    )
    th = thresholds.select(
        "repo",
        F.col("crap_max").alias("crap_target"),
        F.col("cognitive_max").alias("cognitive_target"),
        F.col("coverage_min").alias("coverage_target"),
        F.col("mutation_min").alias("mutation_target"),
    )

    def scored(df: DataFrame, key: str) -> DataFrame:
        return df.select(*SNAP, F.col(key).alias("id"), *(c for c in SCORES if c in df.columns))

    m = scored(metrics, "id")
    for df, key in ((packages, "package"), (modules, "module")):
        if df is not None:
            m = m.unionByName(scored(df, key), allowMissingColumns=True)
    m = m.withColumns({c: F.lit(None).cast("string") for c in SCORES if c not in m.columns})
    target = F.when(F.col("kind") == PACKAGE, F.col("name")).otherwise(paths.short("id"))
    return (
        nodes.select(*ID, "kind", "name", "file", lines.alias("lines"), target.alias("check_target"))
        .join(m, ID, "left")
        .join(th, "repo", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ["killed", "survived", "not_covered"]})
        .withColumn("worst", paths.short("worst"))
    )


def node_ranges(nodes: DataFrame, line_states: DataFrame) -> DataFrame:
    """Uncovered and partly covered lines of functions, one row per range:
    ``…, id, state, start, end, text`` (``file.go:3–5``)."""
    runs = [
        state_runs(line_states, state).select(*ID, F.lit(state).alias("state"), "start", "end") for state in ("uncovered", "partial")
    ]
    base = F.substring_index("file", "/", -1)
    return (
        runs[0]
        .unionByName(runs[1])
        .join(nodes.select(*ID, base.alias("_base")), ID)
        .select(*ID, "state", "start", "end", F.concat("_base", F.lit(":"), range_text("start", "end")).alias("text"))
    )
