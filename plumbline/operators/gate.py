"""The threshold gate: breaches, what was not measured, pass or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions.text import joined_ranges
from plumbline.operators.coverage import state_runs
from plumbline.operators.ranking import first_per
from plumbline.schemas import LIVED, SNAP

ID = SNAP + ["id"]
# Hints of the breaches and of the summary.
COGNITIVE_HINT = "extract the nested block or invert conditions to flatten"
CRAP_HINT = "add tests for the uncovered branches, or split the function"
COVERAGE_HINT = "add tests for the uncovered lines"
MUTATION_HINT = "each survivor is one missing assertion"
MISSING_HINTS = {
    "crap": "coverage missing or stale (run the analysis with coverage)",
    "mutation": "mutation not run, or no mutant could run (run the mutation tests)",
}
# A critical path must be covered completely.
CRITICAL_LIMIT = 100.0


def in_scope(metrics: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Functions to check; a function named twice is checked once."""
    return metrics if scope is None else metrics.join(scope.select(*ID).distinct(), ID, "left_semi")


def report_rows(metrics: DataFrame) -> DataFrame:
    """One line per function; stale when either measurement is."""
    stale = F.coalesce("coverage_stale", F.lit(False)) | F.coalesce("mutation_stale", F.lit(False))
    return metrics.select(
        *ID,
        paths.short("id").alias("name"),
        "crap",
        F.col("percent").alias("coverage"),
        F.col("score").alias("mutation"),
        "cognitive",
        stale.alias("stale"),
    )


def _item(cond: Column, kind: str, value: Column, limit: Column, hint: Column) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(kind).alias("kind"),
            value.cast("double").alias("value"),
            limit.cast("double").alias("limit"),
            hint.alias("hint"),
        ),
    )


def breaches(
    metrics: DataFrame,
    thresholds: DataFrame,
    critical_files: DataFrame | None = None,
    uncovered: DataFrame | None = None,
    fast: bool = False,
    shown_ranges: int = 10,
) -> DataFrame:
    """Functions over a limit: ``…, id, name, kind, value, limit, hint``.

    All comparisons are strict, so a value on its limit passes; a missing
    value never breaches. ``critical_files``: ``repo, file`` whose functions
    need full coverage. ``uncovered``: uncovered runs, named in the hint.
    In fast mode only cognitive complexity, and CRAP on current coverage, are
    checked.
    """
    th = thresholds.select(
        "repo", *[F.col(c).alias(f"_{c}") for c in ["crap_max", "cognitive_max", "coverage_min", "mutation_min"]]
    )
    m = metrics.join(th, "repo")
    limit = F.col("_coverage_min")
    if critical_files is not None:
        flag = critical_files.select("repo", "file").distinct().withColumn("_critical", F.lit(True))
        m = m.join(flag, ["repo", "file"], "left")
        limit = F.when(F.col("_critical"), F.lit(CRITICAL_LIMIT)).otherwise(limit)
    where: Column = F.lit(COVERAGE_HINT)
    if uncovered is not None and not fast:
        top = first_per(uncovered, ID, ["start"], shown_ranges)
        m = m.join(joined_ranges(top), ID, "left")
        named = F.concat(
            F.lit("add tests for lines "), F.substring_index("file", "/", -1), F.lit(":"), F.col("ranges")
        )
        where = F.coalesce(named, where)
    stale = F.coalesce("coverage_stale", F.lit(False))
    crap_over = F.col("crap") > F.col("_crap_max")
    if fast:
        crap_over = crap_over & ~stale
    found = [
        _item(
            F.col("cognitive") > F.col("_cognitive_max"),
            "cognitive",
            F.col("cognitive"),
            F.col("_cognitive_max"),
            F.lit(COGNITIVE_HINT),
        ),
        _item(crap_over, "crap", F.col("crap"), F.col("_crap_max"), F.lit(CRAP_HINT)),
    ]
    if not fast:
        fresh = ~F.coalesce("mutation_stale", F.lit(False))
        found += [
            _item(F.col("percent") < limit, "coverage", F.col("percent"), limit, where),
            _item(
                fresh & (F.col("score") < F.col("_mutation_min")),
                "mutation",
                F.col("score"),
                F.col("_mutation_min"),
                F.lit(MUTATION_HINT),
            ),
        ]
    return m.select(
        *ID, paths.short("id").alias("name"), F.explode(F.array_compact(F.array(*found))).alias("_b")
    ).select(*ID, "name", "_b.*")


def breach_inputs(
    metrics: DataFrame, thresholds: DataFrame, line_states: DataFrame, critical_files: DataFrame | None = None
) -> DataFrame:
    """A digest for each function of all that :func:`breaches` makes of it: ``…, id, digest``.

    Uncovered lines go in by XOR, which merges in any order; a function has a line once.
    """
    limits = ["crap_max", "cognitive_max", "coverage_min", "mutation_min"]
    own = ["file", "cognitive", "crap", "percent", "coverage_stale", "score", "mutation_stale"]
    marks = [F.bit_xor(F.xxhash64("line", F.lit(i))).alias(f"lines_{i}") for i in range(2)]
    lines = line_states.where("state = 'uncovered'").groupBy(*ID).agg(*marks, F.count("*").alias("lines"))
    m = metrics.select(*ID, *own).join(thresholds.select("repo", *limits), "repo").join(lines, ID, "left")
    parts = [*own, *limits, "lines_0", "lines_1", "lines"]
    if critical_files is not None:
        flag = critical_files.select("repo", "file").distinct().withColumn("critical", F.lit(True))
        m = m.join(flag, ["repo", "file"], "left")
        parts.append("critical")
    return m.select(*ID, F.sha2(F.to_json(F.struct(*parts)), 256).alias("digest"))


def renewed_breaches(
    before: DataFrame,
    inputs_before: DataFrame,
    inputs: DataFrame,
    metrics: DataFrame,
    thresholds: DataFrame,
    line_states: DataFrame,
    critical_files: DataFrame | None = None,
) -> DataFrame:
    """:func:`breaches` of a following snapshot, from those ``before`` it.

    ``inputs_before`` and ``inputs`` are the digests of both (one snapshot of a repository in each). Only functions
    with another digest, and their lines, are looked at again; those that are gone lose their breaches.
    """
    same = inputs.join(inputs_before.select("repo", "id", "digest"), ["repo", "id", "digest"], "left_semi")
    other = inputs.join(inputs_before.select("repo", "id", "digest"), ["repo", "id", "digest"], "left_anti").select(*ID)
    runs = state_runs(line_states.join(other, ID, "left_semi"), "uncovered")
    new = breaches(metrics.join(other, ID, "left_semi"), thresholds, critical_files, runs)
    kept = before.drop("snapshot_id").join(same.select(*ID), ["repo", "id"]).select(*new.columns)
    return kept.unionByName(new)


def breach_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each breach from one snapshot of a repository to the next: ``repo, id, kind, change``
    (``appeared``, ``resolved``, ``kept``), ``value_before, value``."""
    key = ["repo", "id", "kind"]
    old = before.select(*key, F.col("value").alias("value_before"), F.lit(True).alias("_old"))
    new = after.select(*key, "value", F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "appeared").when(F.col("_new").isNull(), "resolved").otherwise("kept")
    return old.join(new, key, "full").select(*key, change.alias("change"), "value_before", "value")


def survivor_details(breach_rows: DataFrame, mutants: DataFrame, files: DataFrame, shown: int = 5) -> DataFrame:
    """The first survivors of functions with a mutation breach:
    ``…, id, position, detail``. ``files``: ``…, id, file``."""
    hit = breach_rows.where("kind = 'mutation'").select(*ID)
    lived = mutants.where(F.col("status") == LIVED).select(*ID, "line", "col", "type", "description")
    lived = lived.join(hit, ID, "left_semi")
    top = first_per(lived, ID, ["line", "col", "type", "description"], shown)
    text = F.concat(
        F.substring_index("file", "/", -1), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("description")
    )
    return top.join(files.select(*ID, "file"), ID).select(*ID, "position", text.alias("detail"))


def not_measured(metrics: DataFrame, package_errors: DataFrame | None = None, fast: bool = False) -> DataFrame:
    """Values that could not be checked: ``…, id, name, metric, reason``.

    ``package_errors``: ``repo, package, error`` of failed coverage runs.
    """
    m = metrics
    error: Column = F.lit(None).cast("string")
    if package_errors is not None:
        e = package_errors.select("repo", F.col("package").alias("parent"), F.col("error").alias("_error"))
        m = m.join(e, ["repo", "parent"], "left")
        error = F.when(F.col("_error") != "", F.col("_error"))
    name = paths.short("id")
    never = F.coalesce(
        F.concat(F.lit("coverage not measured: "), error),
        F.concat(F.lit("coverage not measured yet (run: check "), name, F.lit(")")),
    )
    stale = F.coalesce("coverage_stale", F.lit(False))

    def row(cond: Column, metric: str, reason: Column) -> Column:
        return F.when(cond, F.struct(F.lit(metric).alias("metric"), reason.alias("reason")))

    found = [row(F.col("crap").isNull(), "crap", never)]
    if fast:
        found.append(
            row(
                F.col("crap").isNotNull() & stale,
                "crap",
                F.concat(F.lit("coverage is stale since the last change (run: check "), name, F.lit(")")),
            )
        )
    else:
        absent = F.col("killed").isNull() | F.coalesce("mutation_stale", F.lit(False))
        stuck = F.col("score").isNull() & (F.coalesce("testable", F.lit(0)) > 0)
        found += [
            row(
                absent,
                "mutation",
                F.concat(F.lit("mutation not run since last change (run: mutate "), name, F.lit(")")),
            ),
            row(
                ~absent & stuck,
                "mutation",
                F.concat(
                    F.lit("no mutant could run: "), F.col("testable").cast("string"), F.lit(" not covered by tests")
                ),
            ),
        ]
    return m.select(*ID, name.alias("name"), F.explode(F.array_compact(F.array(*found))).alias("_n")).select(
        *ID, "name", "_n.*"
    )


def not_measured_summary(missing: DataFrame) -> DataFrame:
    """Functions per metric that could not be checked, with what to do."""
    known = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in MISSING_HINTS.items()])
    return (
        missing.groupBy(*SNAP, "metric")
        .agg(F.count("*").alias("functions"))
        .withColumn("hint", F.coalesce(known, F.concat("metric", F.lit(" not measured"))))
    )


def verdict(metrics: DataFrame, breach_rows: DataFrame) -> DataFrame:
    """Per snapshot: functions checked, breaches, and whether it passes."""
    n = breach_rows.groupBy(*SNAP).agg(F.count("*").alias("breaches"))
    return (
        metrics.groupBy(*SNAP)
        .agg(F.count("*").alias("functions"))
        .join(n, SNAP, "left")
        .withColumn("breaches", F.coalesce("breaches", F.lit(0)))
        .withColumn("pass", F.col("breaches") == 0)
    )


def scope_notes(placed_notes: DataFrame, scope: DataFrame) -> DataFrame:
    """Open notes on checked functions: ``…, id, name, line, author, text``."""
    s = scope.select(*SNAP, F.col("id").alias("target")).distinct()
    return (
        placed_notes.where(~F.coalesce("resolved", F.lit(False)))
        .join(s, SNAP + ["target"], "left_semi")
        .select(*SNAP, F.col("target").alias("id"), paths.short("target").alias("name"), "line", "author", "text")
    )
