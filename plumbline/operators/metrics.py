"""Assembly of the function metrics table and of function grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.operators.mutation import not_covered_on_states, testable
from plumbline.schemas import SNAP

ID = SNAP + ["id"]
COVERAGE_COLS = ["stmts", "covered", "percent", "coverage_stale", "lines_known", "reached"]
COVERAGE_TYPES = ["long", "long", "double", "boolean", "boolean", "boolean"]
MUTATION_COLS = ["killed", "survived", "not_covered", "timed_out", "score", "mutation_stale"]
MUTATION_TYPES = ["long", "long", "long", "long", "double", "boolean"]


def churn_columns(
    funcs: DataFrame, function_churn: DataFrame | None, file_churn: DataFrame | None
) -> DataFrame:
    """Adds ``churn`` and ``churn_scope``: the function's own churn where it
    was measured, else its file's (0 for a file without commits), else NULL."""
    out = funcs
    own: Column = F.lit(None).cast("long")
    of_file: Column = F.lit(None).cast("long")
    if function_churn is not None:
        out = out.join(function_churn.select(*ID, F.col("churn").alias("_own")), ID, "left")
        own = F.col("_own")
    if file_churn is not None:
        out = out.join(file_churn.select("repo", "file", F.col("churn").alias("_file")), ["repo", "file"], "left")
        of_file = F.coalesce("_file", F.lit(0))
    scope = F.when(own.isNotNull(), F.lit("function")).when(of_file.isNotNull(), F.lit("file"))
    return out.withColumns({"churn": F.coalesce(own, of_file), "churn_scope": scope}).drop("_own", "_file")


def grade_columns(m: DataFrame) -> DataFrame:
    """The four grades from ``crap``, coverage, mutation and ``testable``."""
    crap = scores.grade_crap("crap")
    graded = scores.mutation_graded(F.col("killed").isNotNull(), "score", "testable")
    return (
        m.withColumn("grade_crap", crap)
        .withColumn("grade_coverage", scores.grade_coverage("stmts", "percent"))
        .withColumn("grade_mutation", F.when(graded, scores.grade_mutation("score")))
        .withColumn("grade_combined", scores.combined("grade_crap", "grade_mutation"))
    )


def function_metrics(
    funcs: DataFrame,
    facts: DataFrame,
    coverage: DataFrame | None,
    mutation: DataFrame | None,
    mutants: DataFrame | None,
    states: DataFrame | None,
    function_churn: DataFrame | None = None,
    file_churn: DataFrame | None = None,
    given: DataFrame | None = None,
    on_state: DataFrame | None = None,
) -> DataFrame:
    """One row per function with every metric; NULL where not measured, for all
    functions where a table is None. ``on_state``: what ``not_covered_on_states``
    makes of mutants and states, if that is there already.

    ``given`` holds metrics that came with an external graph (``crap`` plus
    the coverage and mutation columns); they are used as they are where
    nothing was measured here.
    """
    base = churn_columns(
        funcs.select(*ID, "name", "parent", "file", "line", "end_line"), function_churn, file_churn
    ).join(facts.select(*ID, "cc", "cognitive", "loc"), ID, "left")
    m = _with_coverage(base, coverage).withColumn("crap", scores.crap("cc", "stmts", "covered"))
    if on_state is None and mutants is not None and states is not None:
        on_state = not_covered_on_states(mutants, states)
    m = _with_mutation(m, mutation, on_state)
    if given is not None:
        m = _fill_given(m, given)
    return grade_columns(m)


def _with_coverage(m: DataFrame, coverage: DataFrame | None) -> DataFrame:
    if coverage is None:
        return m.withColumns({c: F.lit(None).cast(t) for c, t in zip(COVERAGE_COLS, COVERAGE_TYPES)})
    return m.join(coverage.withColumnRenamed("stale", "coverage_stale").select(*ID, *COVERAGE_COLS), ID, "left")


def _with_mutation(m: DataFrame, mutation: DataFrame | None, on_state: DataFrame | None) -> DataFrame:
    """What is testable follows from columns that are there by then: neither table is made twice."""
    if mutation is None:
        none = {c: F.lit(None).cast(t) for c, t in zip(MUTATION_COLS, MUTATION_TYPES)}
        return m.withColumns({**none, "testable": F.lit(None).cast("long")})
    out = m.join(mutation.withColumnRenamed("stale", "mutation_stale").select(*ID, *MUTATION_COLS, F.lit(True).alias("_mutated")), ID, "left")
    if on_state is None:
        out = out.withColumn("on_state", F.lit(None).cast("long"))
    else:
        out = out.join(on_state, ID, "left")
    return out.withColumn("testable", F.when(F.col("_mutated"), testable())).drop("_mutated", "on_state")


def _fill_given(m: DataFrame, given: DataFrame) -> DataFrame:
    extra = COVERAGE_COLS + ["crap"] + MUTATION_COLS + ["testable"]
    g = given.select(*ID, *[F.col(c).alias(f"_g_{c}") for c in extra])
    joined = m.join(g, ID, "left")
    has_cov, has_mut = F.col("stmts").isNotNull(), F.col("killed").isNotNull()
    crap = F.when(has_cov & F.col("cc").isNotNull(), F.col("crap")).otherwise(F.col("_g_crap"))
    pick = {"crap": crap}
    for c in COVERAGE_COLS:
        pick[c] = F.when(has_cov, F.col(c)).otherwise(F.col(f"_g_{c}"))
    for c in MUTATION_COLS + ["testable"]:
        pick[c] = F.when(has_mut, F.col(c)).otherwise(F.col(f"_g_{c}"))
    return joined.withColumns(pick).drop(*[f"_g_{c}" for c in extra])


def is_stale(m: DataFrame) -> Column:
    """Coverage staleness counts only where a complexity is known."""
    cov = F.coalesce(m["coverage_stale"], F.lit(False)) & m["cc"].isNotNull()
    return cov | F.coalesce(m["mutation_stale"], F.lit(False))


def newly_stale(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Functions stale in the next snapshot that were not (or did not exist)
    in the previous one: ``repo, id``."""
    was = previous.where(is_stale(previous)).select("repo", "id")
    return following.where(is_stale(following)).select("repo", "id").join(was, ["repo", "id"], "left_anti")
