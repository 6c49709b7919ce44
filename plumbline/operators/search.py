"""Finding nodes: id resolution, glossary lookup, fuzzy search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.schemas import FUNC, PACKAGE, SNAP

ID = SNAP + ["id"]


def suffixes(node_id: Column | str) -> Column:
    """The id and every suffix of it that follows a ``/`` or ``.``."""
    c = F.col(node_id) if isinstance(node_id, str) else node_id
    chars = F.sequence(F.lit(1), F.length(c))
    cuts = F.filter(chars, lambda i: c.substr(i, F.lit(1)).isin("/", "."))
    tails = F.transform(cuts, lambda i: c.substr(i + 1, F.length(c)))
    return F.filter(F.array_distinct(tails), lambda s: s != "")


def candidates(ids: DataFrame, queries: DataFrame) -> DataFrame:
    """All matches: ``repo, snapshot_id, query, id, exact``.

    Ids offer their boundary suffixes and queries match by equality; nothing
    is compared pairwise.
    """
    q = queries.select(*SNAP, "query").where("query <> ''").distinct()
    exact = ids.select(*ID).join(q.withColumn("id", F.col("query")), ID).withColumn("exact", F.lit(True))
    tail = (
        ids.select(*ID)
        .withColumn("query", F.explode(suffixes("id")))
        .join(q, SNAP + ["query"])
        .withColumn("exact", F.lit(False))
    )
    return exact.select(*SNAP, "query", "id", "exact").unionByName(tail.select(*SNAP, "query", "id", "exact"))


def resolve(ids: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: ``status`` (``exact``, ``unique``, ``ambiguous``,
    ``not_found``), the ``id`` where there is one, and the number of matches.
    The matches of an ambiguous query are in :func:`candidates`."""
    found = candidates(ids, queries).groupBy(*SNAP, "query").agg(
        F.bool_or("exact").alias("exact"),
        F.count_if(~F.col("exact")).alias("n"),
        F.min("id").alias("one"),
    )
    status = (
        F.when(F.col("exact"), F.lit("exact"))
        .when(F.coalesce("n", F.lit(0)) == 0, F.lit("not_found"))
        .when(F.col("n") == 1, F.lit("unique"))
        .otherwise(F.lit("ambiguous"))
    )
    return (
        queries.select(*SNAP, "query")
        .distinct()
        .join(found, SNAP + ["query"], "left")
        .select(
            *SNAP,
            "query",
            status.alias("status"),
            F.when(F.col("exact"), F.col("query")).when(F.col("n") == 1, F.col("one")).alias("id"),
            F.when(F.col("exact"), F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).alias("matches"),
        )
    )


def resolve_packages(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """As :func:`resolve`, but a package's directory (``./`` allowed) wins."""
    pk = nodes.where(F.col("kind") == PACKAGE)
    q = queries.select(*SNAP, "query").distinct()
    as_dir = (
        q.withColumn("dir", paths.clean_path(F.regexp_replace("query", r"^\./", "")))
        .join(pk.select(*SNAP, "dir", "id"), SNAP + ["dir"])
        .groupBy(*SNAP, "query")
        .agg(F.min("id").alias("_dir_id"))
    )
    plain = resolve(nodes, q)
    return plain.join(as_dir, SNAP + ["query"], "left").select(
        *SNAP,
        "query",
        F.when(F.col("_dir_id").isNotNull(), F.lit("directory")).otherwise(F.col("status")).alias("status"),
        F.coalesce("_dir_id", "id").alias("id"),
    )


def match_score(query: Column, label: Column) -> Column:
    """Position of the query in the label; else 100 plus the gaps of the first
    in-order match of its letters; NULL without one. Both lower case."""
    direct = F.position(query, label)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        nxt = F.position(ch, label, acc["at"] + 1)
        return F.struct(
            F.when(nxt > 0, nxt).otherwise(acc["at"]).alias("at"),
            (acc["gaps"] + F.when(acc["at"] > 0, nxt - acc["at"] - 1).otherwise(F.lit(0))).alias("gaps"),
            (acc["ok"] & (nxt > 0)).alias("ok"),
        )

    letters = F.filter(F.split(query, ""), lambda c: c != "")
    loose = F.aggregate(letters, start, step, lambda acc: F.when(acc["ok"], acc["gaps"] + 100))
    return F.when(direct > 0, direct - 1).otherwise(loose)


def normalise_query(q: str) -> str:
    return "".join(q.lower().split())


def search_items(nodes: DataFrame) -> DataFrame:
    """What a search sees: packages by name, functions by short id."""
    return nodes.where(F.col("kind").isin(PACKAGE, FUNC)).select(
        *ID, "kind", F.when(F.col("kind") == PACKAGE, F.col("name")).otherwise(paths.short("id")).alias("label")
    )


def fuzzy(nodes: DataFrame, queries: list[str], limit: int = 8) -> DataFrame:
    """The best matches of each typed query: tighter and earlier first, then
    shorter labels, then id.

    The queries are parameters of the job, so one pass over the items scores
    them all and keeps ``limit`` rows per query in every task.
    """
    wanted = [(q, normalise_query(q)) for q in dict.fromkeys(queries) if normalise_query(q)]
    if not wanted:
        return search_items(nodes).select(
            *SNAP, F.lit("").alias("query"), "id", "kind", "label", F.lit(0).alias("score"), F.lit(0).alias("position")
        ).where(F.lit(False))
    items = search_items(nodes).withColumn("_label", F.lower("label"))
    hits = F.array(
        *[
            F.struct(F.lit(raw).alias("query"), match_score(F.lit(q), F.col("_label")).alias("score"))
            for raw, q in wanted
        ]
    )
    scored = items.select(*ID, "kind", "label", F.explode(hits).alias("_h")).select(
        *SNAP, F.col("_h.query").alias("query"), "id", "kind", "label", F.col("_h.score").alias("score")
    )
    w = Window.partitionBy(*SNAP, "query").orderBy("score", F.length("label"), "id")
    return (
        scored.where("score IS NOT NULL")
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= limit)
    )


# --- glossary ---------------------------------------------------------------


def term_key(name: Column | str) -> Column:
    """Lookup key of a term: lower case, spaces and hyphens as underscores."""
    c = F.col(name) if isinstance(name, str) else name
    return F.translate(F.lower(F.trim(c)), " -", "__")


def substitute(text: Column | str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders."""
    out = F.col(text) if isinstance(text, str) else text
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def plain_number(v: Column) -> Column:
    """A number as people write it: no trailing ``.0``."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def lookup_terms(queries: DataFrame, terms: DataFrame, thresholds: DataFrame, churn_months: int = 12) -> DataFrame:
    """Glossary texts for queried names, with each repository's limits filled
    in. ``terms``: ``term, title, short, body, good``; ``queries``: ``repo,
    query``. An unknown name keeps a row with NULL texts."""
    values = {
        "crap_max": plain_number(F.col("crap_max")),
        "coverage_min": plain_number(F.col("coverage_min")),
        "mutation_min": plain_number(F.col("mutation_min")),
        "cognitive_max": F.col("cognitive_max").cast("string"),
        "churn_months": F.lit(str(churn_months)),
    }
    texts = ["title", "short", "body", "good"]
    return (
        queries.select("repo", "query")
        .distinct()
        .withColumn("term", term_key("query"))
        .join(terms, "term", "left")
        .join(thresholds, "repo", "left")
        .select("repo", "query", "term", *[substitute(t, values).alias(t) for t in texts])
    )
