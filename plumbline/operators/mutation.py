"""Mutation results: attribution, tallies, descriptions, caches, run plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import mutation_score, run_efficacy
from plumbline.operators.coverage import WORD_BITS, has_line
from plumbline.operators.intervals import FILE, with_owner
from plumbline.schemas import COUNTED, KILLED, LIVED, NOT_COVERED, SNAP, TIMED_OUT
from plumbline.session import spread_join

ID = SNAP + ["id"]

# What each mutation type turns a token into.
REPLACEMENTS = {
    "ARITHMETIC_BASE": {"+": "-", "*": "/", "/": "*", "%": "*", "-": "+"},
    "CONDITIONALS_BOUNDARY": {">=": ">", ">": ">=", "<=": "<", "<": "<="},
    "CONDITIONALS_NEGATION": {"==": "!=", ">=": "<", ">": "<=", "<=": ">", "<": ">=", "!=": "=="},
    "INCREMENT_DECREMENT": {"--": "++", "++": "--"},
    "INVERT_ASSIGNMENTS": {"+=": "-=", "*=": "/=", "/=": "*=", "%=": "%=", "-=": "+="},
    "INVERT_BITWISE": {"&": "|", "|": "&", "^": "&", "&^": "&", "<<": ">>", ">>": "<<"},
    "INVERT_BWASSIGN": {"&=": "|=", "|=": "&=", "^=": "&=", "&^=": "&=", "<<=": ">>=", ">>=": "<<="},
    "INVERT_LOGICAL": {"&&": "||", "||": "&&"},
    "INVERT_LOOPCTRL": {"break": "continue", "continue": "break"},
    "INVERT_NEGATIVES": {"-": "+"},
    "REMOVE_SELF_ASSIGNMENTS": {
        "+=": "=",
        "&=": "=",
        "&^=": "=",
        "*=": "=",
        "|=": "=",
        "/=": "=",
        "%=": "=",
        "<<=": "=",
        ">>=": "=",
        "-=": "=",
        "^=": "=",
    },
}
# The test that is missing when a mutant of the type survives.
HINTS = {
    "CONDITIONALS_BOUNDARY": "No test puts the value exactly on the boundary.",
    "CONDITIONALS_NEGATION": "No test checks the opposite outcome of this condition.",
    "ARITHMETIC_BASE": "No test checks the exact result of this calculation.",
    "INCREMENT_DECREMENT": "No test depends on the exact count or step.",
    "INVERT_NEGATIVES": "No test uses a negative value here.",
    "INVERT_LOGICAL": "No test separates the two sides of this && / ||.",
    "INVERT_ASSIGNMENTS": "No test checks the value assigned here.",
    "INVERT_BITWISE": "No test checks the bits this operation sets.",
    "INVERT_BWASSIGN": "No test checks the bits this assignment sets.",
    "INVERT_LOOPCTRL": "No test depends on this break or continue.",
    "REMOVE_SELF_ASSIGNMENTS": "No test checks the value updated here.",
}
DEFAULT_HINT = "Add an assertion that fails when this line changes."

# The longest token at the start of a text; comments and channel arrows are
# matched first so that their characters are not read as operators.
_TOKEN = (
    r"^(?!//|/\*)(<<=|>>=|&\^=|\.\.\.|<-|\+\+|--|&&|\|\||==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^="
    r"|<<|>>|&\^|[-+*/%&|^<>=!~]|(?:break|continue)(?![\p{L}\p{N}_]))"
)


def replacement_table(spark: SparkSession) -> DataFrame:
    """``type, token, replacement``: a fixed table of about fifty rows."""
    rows = [(t, a, b) for t, m in REPLACEMENTS.items() for a, b in m.items()]
    return spark.createDataFrame(rows, "type string, token string, replacement string")


def hint(mutation_type: Column | str) -> Column:
    t = F.col(mutation_type) if isinstance(mutation_type, str) else mutation_type
    return F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in HINTS.items()], F.lit(DEFAULT_HINT))


def countable(mutants: DataFrame) -> DataFrame:
    return mutants.where(F.col("status").isin(COUNTED))


def token_at(text: Column | str, col: Column | str) -> Column:
    """Token that starts at byte column ``col`` (1-based) of a source line."""
    raw = F.encode(text, "UTF-8")
    here = F.substring(raw, F.col(col) if isinstance(col, str) else col, F.lit(9)).cast("string")
    tok = F.regexp_extract(here, _TOKEN, 1)
    return F.when(tok != "", tok)


def describe(mutants: DataFrame, source_lines: DataFrame, salts: int = 1) -> DataFrame:
    """Adds ``description``: ``token → replacement``, or the bare type where
    the type, the line or the token is unknown.

    Only lines that hold a mutant are kept of the source before texts meet
    mutants.
    """
    spark = mutants.sparkSession
    place = FILE + ["line"]
    held = mutants.select(*place).distinct()
    text = source_lines.select(*FILE, F.col("n").alias("line"), "text").join(held, place, "left_semi")
    table = F.broadcast(replacement_table(spark))
    return (
        spread_join(mutants, text, place, ["col", "type", "status"], salts, "left")
        .withColumn("token", token_at("text", "col"))
        .join(table, ["type", "token"], "left")
        .withColumn(
            "description",
            F.when(F.col("replacement").isNull(), F.col("type")).otherwise(
                F.concat("token", F.lit(" → "), "replacement")
            ),
        )
        .drop("text", "token", "replacement")
    )


def attribute(funcs: DataFrame, file_mutants: DataFrame) -> DataFrame:
    """Countable mutants with the ``id`` of the function they lie in; mutants
    between functions are dropped."""
    return with_owner(funcs, countable(file_mutants), ["col", "type", "status"])


def _counts(status_count: Column) -> list[Column]:
    def of(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, status_count).otherwise(0)).cast("long")

    return [
        of(KILLED).alias("killed"),
        of(LIVED).alias("survived"),
        of(NOT_COVERED).alias("not_covered"),
        of(TIMED_OUT).alias("timed_out"),
    ]


def tally(funcs: DataFrame, file_mutants: DataFrame) -> DataFrame:
    """Mutation counts and score of every function in ``funcs``; a function
    without mutants has zero sites.

    Mutants are counted per file, line and status before any join.
    """
    per_line = countable(file_mutants).groupBy(*FILE, "line", "status").count()
    sums = with_owner(funcs, per_line, ["status"]).groupBy(*ID).agg(*_counts(F.col("count")))
    return _scored(funcs, sums)


def count_mutants(funcs: DataFrame, mutants: DataFrame) -> DataFrame:
    """As :func:`tally`, for mutants that already name their function."""
    per_status = countable(mutants).groupBy(*ID, "status").count()
    return _scored(funcs, per_status.groupBy(*ID).agg(*_counts(F.col("count"))))


def _scored(funcs: DataFrame, sums: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ["killed", "survived", "not_covered", "timed_out"]}
    return (
        funcs.select(*ID)
        .join(sums, ID, "left")
        .withColumns(zero)
        .select(
            *ID,
            *zero,
            mutation_score("killed", "timed_out", "survived").alias("score"),
            F.lit(False).alias("stale"),
        )
    )


def testable_not_covered(mutation: DataFrame, coverage: DataFrame, mutants: DataFrame, states: DataFrame) -> DataFrame:
    """NOT COVERED mutants a test could reach: ``…, id, testable``.

    In a function that ran, a mutant on a line without any coverage block can
    never be tested. Without line data, or where nothing ran, all count.
    """
    known = coverage.select(*ID, "lines_known", "reached")
    return (
        mutation.select(*ID, "not_covered")
        .join(known, ID, "left")
        .join(not_covered_on_states(mutants, states), ID, "left")
        .select(*ID, testable().alias("testable"))
    )


def not_covered_on_states(mutants: DataFrame, states: DataFrame) -> DataFrame:
    """NOT COVERED mutants on lines with a state: ``…, id, on_state``."""
    per_line = mutants.where(F.col("status") == NOT_COVERED).groupBy(*ID, "line").count()
    return (
        per_line.join(states.select(*ID, "line"), ID + ["line"], "left_semi")
        .groupBy(*ID)
        .agg(F.sum("count").alias("on_state"))
    )


def not_covered_on_words(mutants: DataFrame, words: DataFrame) -> DataFrame:
    """:func:`not_covered_on_states` from ``coverage.state_words``, 64 lines to a row."""
    per_line = (
        mutants.where(F.col("status") == NOT_COVERED)
        .groupBy(*ID, "line")
        .count()
        .withColumn("_word", F.shiftright("line", WORD_BITS))
    )
    lines = words.select(*ID, "_word", F.col("ran_lines").bitwiseOR(F.col("missed_lines")).alias("_lines"))
    return (
        per_line.join(lines, [*ID, "_word"])
        .where(has_line(F.col("_lines"), F.col("line")))
        .groupBy(*ID)
        .agg(F.sum("count").alias("on_state"))
    )


def testable() -> Column:
    """From a function's coverage and mutation and its mutants ``on_state``."""
    ran = F.col("lines_known") & F.col("reached")
    return F.when(ran, F.coalesce("on_state", F.lit(0))).otherwise(F.col("not_covered"))


def survivors(mutants: DataFrame) -> DataFrame:
    return mutants.where(F.col("status") == LIVED)


# --- cache ------------------------------------------------------------------


def resolve_mutation(funcs: DataFrame, cache: DataFrame, cached_mutants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached results on the current code: ``(mutation, mutants)``."""
    f = funcs.select(*ID, "line", F.col("body_hash").alias("_now"))
    counts = ["killed", "survived", "not_covered", "timed_out"]
    mutation = (
        cache.where("id IS NOT NULL")
        .select("repo", "id", "body_hash", *counts)
        .join(f, ["repo", "id"])
        .select(
            *ID,
            *counts,
            mutation_score("killed", "timed_out", "survived").alias("score"),
            (~F.col("body_hash").eqNullSafe(F.col("_now"))).alias("stale"),
        )
    )
    mutants = cached_mutants.join(f, ["repo", "id"]).select(
        *ID, (F.col("line_offset") + F.col("line")).alias("line"), "col", "type", "status", "description"
    )
    return mutation, mutants


def record_run(
    cache: DataFrame,
    cached_mutants: DataFrame,
    runs: DataFrame,
    funcs: DataFrame,
    mutation: DataFrame,
    mutants: DataFrame,
    outcome: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A package that ran replaces its rows; a failed one keeps its earlier
    rows and records the failure. ``outcome``: one row per package, ``repo,
    package, engine, engine_version, ran_at, error`` (error NULL = it ran)."""
    pkg = ["repo", "package"]
    ok = outcome.where("error IS NULL OR error = ''").select(*pkg, "engine", "engine_version", "ran_at")
    f = funcs.select(*ID, F.col("parent").alias("package"), "body_hash", F.col("line").alias("_base"))
    fresh_f = f.join(ok, pkg)
    counts = ["killed", "survived", "not_covered", "timed_out"]
    fresh = fresh_f.join(mutation.select(*ID, *counts), ID).select(
        *pkg, "engine", "engine_version", "ran_at", "id", "body_hash", *counts
    )
    fresh_mutants = mutants.join(fresh_f.select(*ID, "package", "_base"), ID).select(
        *pkg, "id", (F.col("line") - F.col("_base")).alias("line_offset"), "col", "type", "status", "description"
    )
    state = outcome.select(*pkg, "ran_at", F.when(F.col("error") != "", F.col("error")).alias("error"))
    return (
        cache.join(ok, pkg, "left_anti").select(fresh.columns).unionByName(fresh),
        cached_mutants.join(ok, pkg, "left_anti").select(fresh_mutants.columns).unionByName(fresh_mutants),
        runs.join(outcome, pkg, "left_anti").select(state.columns).unionByName(state),
    )


def current_packages(packages: DataFrame, funcs: DataFrame, cache: DataFrame, runs: DataFrame) -> DataFrame:
    """Packages whose every function has a result for its current body and
    whose last run did not fail: ``repo, snapshot_id, package``."""
    pkg = ["repo", "package"]
    f = funcs.select(*ID, F.col("parent").alias("package"), F.col("body_hash").alias("_now"))
    hit = cache.where("id IS NOT NULL").select("repo", "id", F.col("body_hash").alias("_then"))
    old = (
        f.join(hit, ["repo", "id"], "left")
        .where("_then IS NULL OR NOT (_then <=> _now)")
        .select(*SNAP, "package")
        .distinct()
    )
    good = runs.where("(error IS NULL OR error = '') AND ran_at IS NOT NULL").select(*pkg).distinct()
    return (
        packages.select(*SNAP, F.col("id").alias("package"))
        .join(good, pkg, "left_semi")
        .join(old, SNAP + ["package"], "left_anti")
    )


def run_plan(
    packages: DataFrame,
    funcs: DataFrame,
    metrics: DataFrame,
    current: DataFrame,
    max_functions: int = 40,
    force: bool = False,
) -> DataFrame:
    """What a budgeted mutation run does with each package: ``status`` is
    ``run``, ``up_to_date`` or ``skipped``.

    Due packages go in order of their highest CRAP. A package runs while the
    functions so far stay within the budget; one that does not fit is skipped
    without stopping smaller ones after it, and the first always runs.

    The total never falls, so once a package of some size was skipped, every
    later one of that size is too: of size s only the first ``max // s`` can
    run. That leaves at most ``max·(ln max + 1)`` candidates per repository
    for the sequential part, however many packages there are.
    """
    sized = (
        funcs.select(*ID, F.col("parent").alias("package"))
        .join(metrics.select(*ID, "crap"), ID, "left")
        .groupBy(*SNAP, "package")
        .agg(F.count("*").alias("functions"), F.coalesce(F.max("crap"), F.lit(-1.0)).alias("risk"))
        .join(packages.select(*SNAP, F.col("id").alias("package"), "dir"), SNAP + ["package"])
    )
    key = SNAP + ["package"]
    cur = current.select(*key).distinct().withColumn("_cur", F.lit(True))
    sized = sized.join(cur, key, "left").withColumn(
        "_due", F.lit(True) if force else F.col("_cur").isNull()
    )
    due = sized.where("_due").drop("_cur", "_due")
    done = sized.where("NOT _due").select(*key, "dir", "functions", "risk", F.lit("up_to_date").alias("status"))
    if max_functions <= 0:
        planned = due.select(*key, "dir", "functions", "risk", F.lit("run").alias("status"))
        return planned.unionByName(done)

    order = [F.col("risk").desc(), F.col("package")]
    by_size = Window.partitionBy(*SNAP, "functions").orderBy(*order)
    fits = (
        due.where(F.col("functions") <= max_functions)
        .withColumn("_n", F.row_number().over(by_size))
        .where(F.col("_n") <= max_functions)
        .where(F.col("_n") * F.col("functions") <= max_functions)
        .select(*SNAP, "package", "functions", "risk")
    )
    first = (
        due.groupBy(*SNAP)
        .agg(F.min(F.struct((-F.col("risk")).alias("_r"), "package", "functions")).alias("_f"))
        .select(*SNAP, F.col("_f.package").alias("package"), F.col("_f.functions").alias("functions"), (-F.col("_f._r")).alias("risk"))
    )
    queue = (
        fits.unionByName(first)
        .distinct()
        .groupBy(*SNAP)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("risk")).alias("_r"), "package", "functions"))).alias("_q"))
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<string>)").alias("run"))
    fold = F.aggregate(
        "_q",
        start,
        lambda acc, it: F.when(
            (F.size(acc["run"]) == 0) | (acc["total"] + it["functions"] <= max_functions),
            F.struct(
                (acc["total"] + it["functions"]).alias("total"),
                F.concat(acc["run"], F.array(it["package"])).alias("run"),
            ),
        ).otherwise(acc),
        lambda acc: acc["run"],
    )
    chosen = queue.select(*SNAP, F.explode(fold).alias("package")).withColumn("_run", F.lit(True))
    planned = due.join(chosen, key, "left").select(
        *key,
        "dir",
        "functions",
        "risk",
        F.when(F.col("_run"), F.lit("run")).otherwise(F.lit("skipped")).alias("status"),
    )
    return planned.unionByName(done)


def run_totals(funcs: DataFrame, mutation: DataFrame) -> DataFrame:
    """Per package and, with ``package`` NULL, per repository: what a run
    killed, let live and could not reach."""
    counts = ["killed", "survived", "not_covered", "timed_out"]
    per = (
        funcs.select(*ID, F.col("parent").alias("package"))
        .join(mutation.select(*ID, *counts), ID)
        .groupBy(*SNAP, "package")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    total = per.groupBy(*SNAP).agg(*[F.sum(c).alias(c) for c in counts]).withColumn("package", F.lit(None).cast("string"))
    return per.unionByName(total).withColumn("run_efficacy", run_efficacy("killed", "survived"))
