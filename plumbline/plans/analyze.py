"""From structure and measurements to a finished snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import coverage as cov
from plumbline.operators import mutation as mut
from plumbline.operators import effects, history, intervals, metrics, ranking, rollup, scopes
from plumbline.schemas import MODULE, SNAP
from plumbline.session import settle


@dataclass
class Inputs:
    """Tables of one or many snapshots. None means it was not measured."""

    nodes: DataFrame
    edges: DataFrame | None
    facts: DataFrame
    coverage: DataFrame | None
    line_states: DataFrame | None
    mutation: DataFrame | None
    mutants: DataFrame | None
    commit_files: DataFrame | None = None
    hunks: DataFrame | None = None
    coverage_errors: DataFrame | None = None
    mutation_errors: DataFrame | None = None
    local_effects: DataFrame | None = None
    allow: DataFrame | None = None
    given: DataFrame | None = None
    on_state: DataFrame | None = None


def from_measurements(
    nodes: DataFrame,
    edges: DataFrame | None,
    facts: DataFrame,
    blocks: DataFrame | None,
    file_mutants: DataFrame | None,
    mutated: DataFrame | None = None,
    lines: bool = True,
    **more,
) -> Inputs:
    """Inputs from a profile and engine reports of the same snapshots.

    Mutants and line states are tables of the snapshot that several later
    steps read, so they are written once here; the states only for a job that
    shows ``lines``, since metrics follow from their words. A job that shows
    nothing of the profile or the reports leaves them out.
    """
    funcs = scopes.functions(nodes)
    out = Inputs(nodes, edges, facts, None, None, None, None, **more)
    if blocks is not None:
        words = cov.state_words(funcs, blocks)
        out.coverage = cov.function_coverage(funcs, blocks, words)
        if lines:
            out.line_states = settle(cov.lines_of_words(words), "line-states")
    if file_mutants is not None:
        found = mut.attribute(mutated if mutated is not None else funcs, file_mutants)
        if "description" not in found.columns:
            found = found.withColumn("description", F.col("type"))
        out.mutants = settle(found.select(*SNAP, "id", "line", "col", "type", "status", "description"), "mutants")
        out.mutation = mut.count_mutants(mutated if mutated is not None else funcs, out.mutants)
        if blocks is not None:
            out.on_state = mut.not_covered_on_words(out.mutants, words)
    return out


def effect_rows(nodes: DataFrame) -> DataFrame:
    """Functions whose node already lists effects."""
    return scopes.functions(nodes).where(F.size("effects") > 0).select(*SNAP, "id")


def function_table(i: Inputs, as_of: str | None = None, months: int = 12) -> DataFrame:
    """The metrics of every function."""
    funcs = scopes.functions(i.nodes)
    by_function = None if i.hunks is None else intervals.commits_touching(funcs, i.hunks)
    # every function has a count of its own where there are hunks, so a file's count is never shown then
    by_file = None if i.commit_files is None or i.hunks is not None else history.file_churn(i.commit_files, as_of, months)
    return metrics.function_metrics(
        funcs, i.facts, i.coverage, i.mutation, i.mutants, i.line_states, by_function, by_file, i.given, i.on_state
    )


def analyze(i: Inputs, as_of: str | None = None, months: int = 12) -> dict[str, DataFrame]:
    """All derived tables: ``functions`` (metrics), ``packages``, ``modules``,
    and, with edges, ``purity`` and ``package_purity``."""
    by_dir = None if i.commit_files is None else history.directory_churn(i.commit_files, as_of, months)
    functions = settle(function_table(i, as_of, months), "functions")
    packages, modules = rollup.roll_up(functions, i.nodes, by_dir, i.coverage_errors, i.mutation_errors)
    out = {"functions": functions, "packages": packages, "modules": modules}
    if i.edges is not None:
        local = effect_rows(i.nodes) if i.local_effects is None else i.local_effects
        out["purity"] = effects.propagate(i.nodes, i.edges, local, i.allow)
        out["package_purity"] = rollup.package_purity(i.nodes, out["purity"])
    return out


def worst_packages(
    nodes: DataFrame, facts: DataFrame, blocks: DataFrame, n: int = 10
) -> DataFrame:
    """Flagship: the n worst packages of each repository by highest CRAP,
    with coverage, grades and their worst function."""
    funcs = scopes.functions(nodes)
    c = cov.function_coverage(funcs, blocks)
    none = {
        **{k: F.lit(None).cast("long") for k in ["killed", "survived", "not_covered", "timed_out", "testable"]},
        "score": F.lit(None).cast("double"),
        "mutation_stale": F.lit(None).cast("boolean"),
    }
    m = metrics.grade_columns(
        funcs.select(*SNAP, "id", "name", "parent")
        .join(facts.select(*SNAP, "id", "cc"), SNAP + ["id"], "left")
        .join(c.withColumnRenamed("stale", "coverage_stale"), SNAP + ["id"], "left")
        .withColumn("crap", metrics.scores.crap("cc", "stmts", "covered"))
        .withColumns(none)
    )
    packages, _ = rollup.roll_up(m, nodes.where(F.col("kind") != MODULE))
    return ranking.first_per(packages.where("crap_max IS NOT NULL"), SNAP, [F.col("crap_max").desc(), "package"], n)
