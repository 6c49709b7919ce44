"""External graphs as one plan: read, check against the contract, merge, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import contract
from plumbline.plans.analyze import Inputs, analyze
from plumbline.schemas import MODULE, SNAP
from plumbline.session import settle
from plumbline.sources import readers

MEASURED = ["facts", "coverage", "line_states", "mutation", "mutants"]


def merge_external(snapshot: dict[str, DataFrame], graphs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A snapshot's tables together with those of external graphs that keep the contract.

    ``snapshot``: ``nodes``, ``edges`` and any of ``facts, coverage, line_states,
    mutation, mutants``; ``graphs``: as ``read_external_graphs`` gives
    them. A source that breaks one rule is left out as a whole and stands as one
    package whose error says why. Also returned: ``problems`` (one row per broken
    rule) and ``failed`` (one row per such source). Ids are unique over the
    snapshot and all sources, so two sources may not use one id.
    """
    graphs = {k: settle(df, f"external-{k}") for k, df in graphs.items()}
    key = contract.KEY
    existing = snapshot["nodes"].select(*SNAP, "id")
    problems = settle(contract.problems(graphs["nodes"], graphs["edges"], graphs["metrics"], existing), "contract-problems")
    failed = settle(contract.failed_sources(problems, graphs["unreadable"]), "failed-sources")
    modules = snapshot["nodes"].where(F.col("kind") == MODULE)
    nodes = contract.merged_nodes(graphs["nodes"], failed, modules)
    nodes = nodes.unionByName(contract.not_measured_packages(failed, modules), allowMissingColumns=True)
    kept = failed.select(*key)
    edges = graphs["edges"].join(kept, key, "left_anti").select(*SNAP, "from", "to", "kind")
    flat = readers.flatten_metrics(graphs["metric_structs"].join(kept, key, "left_anti").drop("source"))
    out = {
        "nodes": snapshot["nodes"].unionByName(nodes, allowMissingColumns=True),
        "edges": snapshot["edges"].unionByName(edges, allowMissingColumns=True).dropDuplicates([*SNAP, "from", "to", "kind"]),
        "problems": problems,
        "failed": failed,
    }
    for name in MEASURED:
        own = snapshot.get(name)
        out[name] = flat[name] if own is None else own.unionByName(flat[name], allowMissingColumns=True)
    return out


def analyze_external(spark: SparkSession, path: str, snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All derived tables of a snapshot and the external graphs below ``path``, with ``nodes``, ``problems`` and ``failed``."""
    t = merge_external(snapshot, readers.read_external_graphs(spark, path))
    nodes = settle(t["nodes"], "merged-nodes")
    measured = {n: settle(t[n], f"merged-{n}") for n in MEASURED}
    errors = nodes.where(F.col("id").startswith("provider:")).select(*SNAP, F.col("id").alias("package"), F.col("errors")[0].alias("error"))
    out = analyze(Inputs(nodes=nodes, edges=settle(t["edges"], "merged-edges"), coverage_errors=errors, **measured))
    return out | {"nodes": nodes, "problems": t["problems"], "failed": t["failed"]}
