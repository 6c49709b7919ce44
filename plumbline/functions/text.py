"""Texts people read: labels, ranges, scores beside targets, fix prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.schemas import EXTERNAL, FUNC, MODULE, PACKAGE, SNAP, TYPE

ID = SNAP + ["id"]
DASH = "—"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _s(col: Column | str) -> Column:
    return _c(col).cast("string")


def number(col: Column | str) -> Column:
    """Shortest decimal form: 70.6, 100."""
    return F.regexp_replace(_s(col), r"\.0$", "")


def fixed1(col: Column | str) -> Column:
    return F.format_string("%.1f", _c(col))


def range_text(start: Column | str, end: Column | str) -> Column:
    s, e = _c(start), _c(end)
    return F.when(s == e, _s(s)).otherwise(F.concat(_s(s), F.lit("–"), _s(e)))


def location(file: Column | str, line: Column | str, end_line: Column | str) -> Column:
    return F.concat(
        _c(file), F.lit(":"), F.when(_c(end_line) > _c(line), range_text(line, end_line)).otherwise(_s(line))
    )


def kind_label() -> Column:
    """Label of the node row (``kind``, ``exported``, ``type_kind``)."""
    k = F.col("kind")
    return (
        F.when((k == FUNC) & F.coalesce("exported", F.lit(False)), F.lit("function · exported"))
        .when(k == FUNC, F.lit("function · unexported"))
        .when(k == TYPE, F.concat(F.lit("type · "), F.coalesce("type_kind", F.lit(""))))
        .when(k == EXTERNAL, F.lit("external module"))
        .otherwise(k)
    )


def purity_label(kind: Column | str, pure: Column | str) -> Column:
    """`` · λ pure`` or `` · effectful``; packages are a core or a shell."""
    p, pkg = _c(pure), _c(kind) == PACKAGE
    return (
        F.when(p.isNull(), F.lit(""))
        .when(p & pkg, F.lit(" · λ pure core"))
        .when(p, F.lit(" · λ pure"))
        .when(pkg, F.lit(" · effectful shell"))
        .otherwise(F.lit(" · effectful"))
    )


def or_not_measured(value: Column | str, text: Column) -> Column:
    return F.when(_c(value).isNull(), F.lit("not measured")).otherwise(text)


def crap_label(crap: Column | str, grade: Column | str) -> Column:
    graded = F.when(_c(grade).isNull(), F.lit("")).otherwise(F.concat(F.lit("  (grade "), _s(grade), F.lit(")")))
    return or_not_measured(crap, F.concat(fixed1(crap), graded))


def coverage_label() -> Column:
    """``75% (3 of 4 statements)  (grade 6)  stale`` from the metrics row."""
    grade = F.when(F.col("grade_coverage").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("  (grade "), _s("grade_coverage"), F.lit(")"))
    )
    stale = F.when(F.coalesce("coverage_stale", F.lit(False)), F.lit("  stale")).otherwise(F.lit(""))
    full = F.concat(
        number("percent"), F.lit("% ("), _s("covered"), F.lit(" of "), _s("stmts"), F.lit(" statements)"), grade, stale
    )
    return F.when(F.col("stmts").isNull(), F.lit("not measured")).when(
        F.col("percent").isNull(), F.lit("no statements")
    ).otherwise(full)


def mutation_label() -> Column:
    sites = F.col("killed") + F.col("survived") + F.col("not_covered") + F.col("timed_out")
    grade = F.when(F.col("grade_mutation").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("  (grade "), _s("grade_mutation"), F.lit(")"))
    )
    stale = F.when(F.coalesce("mutation_stale", F.lit(False)), F.lit("  stale")).otherwise(F.lit(""))
    full = F.concat(
        number("score"),
        F.lit("% ("),
        _s("killed"),
        F.lit(" killed, "),
        _s("survived"),
        F.lit(" survived, "),
        _s("not_covered"),
        F.lit(" not covered)"),
        grade,
        stale,
    )
    return (
        F.when(F.col("killed").isNull(), F.lit("not measured"))
        .when(sites == 0, F.lit("no mutation sites"))
        .when(F.col("score").isNull(), F.concat(F.lit(f"{DASH} ("), _s("not_covered"), F.lit(" not covered)")))
        .otherwise(full)
    )


def grade_label() -> Column:
    return F.when(F.col("grade_combined").isNull(), F.lit(DASH)).otherwise(
        F.concat(
            _s("grade_combined"),
            F.lit(" of 10 (CRAP "),
            _s("grade_crap"),
            F.lit(", mutation "),
            F.coalesce(_s("grade_mutation"), F.lit("n/a")),
            F.lit(", coverage "),
            _s("grade_coverage"),
            F.lit(")"),
        )
    )


def churn_label(scope: Column | str) -> Column:
    return F.when(_c(scope) == "function", F.lit("Churn (approx.)")).otherwise(F.lit("Churn (file)"))


def label_rows(metrics: DataFrame) -> DataFrame:
    """The labelled values of every function, one column per row of text."""
    return metrics.select(
        *ID,
        crap_label("crap", "grade_crap").alias("crap"),
        or_not_measured("cc", _s("cc")).alias("cc"),
        or_not_measured("cognitive", _s("cognitive")).alias("cognitive"),
        coverage_label().alias("coverage"),
        mutation_label().alias("mutation"),
        or_not_measured("loc", _s("loc")).alias("lines"),
        F.concat(churn_label("churn_scope"), F.lit(": "), or_not_measured("churn", _s("churn"))).alias("churn"),
        grade_label().alias("grade"),
    )


# --- fix prompts ------------------------------------------------------------


def _crap_target(limit: Column) -> Column:
    return F.when(F.col("crap").isNull(), F.lit("CRAP not measured")).otherwise(
        F.concat(F.lit("CRAP "), fixed1("crap"), F.lit(" (target "), number(limit), F.lit(" or less)"))
    )


def _coverage_target(limit: Column) -> Column:
    stale = F.when(F.coalesce("coverage_stale", F.lit(False)), F.lit(", stale")).otherwise(F.lit(""))
    return (
        F.when(F.col("stmts").isNull(), F.lit("coverage not measured"))
        .when(F.col("percent").isNull(), F.lit("no statements"))
        .otherwise(
            F.concat(F.lit("coverage "), number("percent"), F.lit("% (target "), number(limit), F.lit("%+)"), stale)
        )
    )


def _mutation_target(limit: Column) -> Column:
    return (
        F.when(F.col("killed").isNull(), F.lit("mutation not measured"))
        .when(
            F.col("score").isNull(),
            F.concat(F.lit("mutation: no mutant ran ("), _s("not_covered"), F.lit(" not covered)")),
        )
        .otherwise(
            F.concat(
                F.lit("mutation "),
                number("score"),
                F.lit("% (target "),
                number(limit),
                F.lit("%+), "),
                _s("survived"),
                F.lit(" surviving and "),
                _s("not_covered"),
                F.lit(" not-covered mutants"),
            )
        )
    )


def joined_ranges(run_rows: DataFrame, sep: str = ", ") -> DataFrame:
    """``…, id, ranges``: the runs of each function as one text. The text is
    the result, so it is as long as the function has runs."""
    return run_rows.groupBy(*ID).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("start", "end"))), lambda r: range_text(r["start"], r["end"])
            ),
            sep,
        ).alias("ranges")
    )


def joined_survivors(survivors: DataFrame, files: DataFrame, sep: str = "; ") -> DataFrame:
    """``…, id, survivors``: ``file:line description`` in source order.
    ``files``: ``…, id, file``."""
    base = F.substring_index("file", "/", -1)
    return (
        survivors.select(*ID, "line", "col", "type", "description")
        .join(files.select(*ID, "file"), ID)
        .select(
            *ID,
            F.struct(
                "line", "col", "type", F.concat(base, F.lit(":"), _s("line"), F.lit(" "), F.col("description")).alias("t")
            ).alias("_m"),
        )
        .groupBy(*ID)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("_m")), lambda m: m["t"]), sep).alias("survivors"))
    )


def joined_notes(placed: DataFrame) -> DataFrame:
    """``…, id, note_lines``: open notes of a target as prompt lines."""
    where = F.when(F.coalesce("line", F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit(" on line "), _s("line")))
    text = F.concat(F.lit("Note"), where, F.lit(" ("), F.col("author"), F.lit("): "), F.col("text"))
    return (
        placed.groupBy(*SNAP, F.col("target").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("created", F.col("id").alias("note_id"), text.alias("t")))).alias("_n"))
        .select(*ID, F.array_join(F.transform("_n", lambda n: n["t"]), "\n").alias("note_lines"))
    )


def prompts(
    nodes: DataFrame,
    metrics: DataFrame,
    packages: DataFrame,
    thresholds: DataFrame,
    survivors: DataFrame,
    uncovered_runs: DataFrame,
    placed_notes: DataFrame,
    message: str = "",
) -> DataFrame:
    """A self-contained fix prompt for every node: ``…, id, prompt``."""
    name = paths.short("id")
    base = F.substring_index("file", "/", -1)
    th = thresholds.select(
        "repo",
        F.col("crap_max").alias("_crap_max"),
        F.col("coverage_min").alias("_cov_min"),
        F.col("mutation_min").alias("_mut_min"),
    )
    limits = (F.col("_crap_max"), F.col("_cov_min"), F.col("_mut_min"))
    fm = metrics.select(
        *ID, "crap", "cc", "cognitive", "stmts", "percent", "coverage_stale", "killed", "survived", "not_covered", "score"
    )
    f = nodes.where(F.col("kind") == FUNC)
    func_text = (
        f.select(*ID, "file", "line")
        .join(fm, ID, "left")
        .join(th, "repo", "left")
        .join(joined_survivors(survivors, f), ID, "left")
        .join(joined_ranges(uncovered_runs), ID, "left")
        .select(
            *ID,
            name.alias("target"),
            F.concat(
                F.concat(
                    F.lit("Improve "), name, F.lit(" ("), F.col("file"), F.lit(":"), _s("line"), F.lit("). "),
                    F.concat_ws(
                        ", ",
                        _crap_target(limits[0]),
                        F.concat(F.lit("CC "), F.coalesce(_s("cc"), F.lit(DASH))),
                        F.concat(F.lit("cognitive "), F.coalesce(_s("cognitive"), F.lit(DASH))),
                        _coverage_target(limits[1]),
                        _mutation_target(limits[2]),
                    ),
                    F.lit("."),
                ),
                F.coalesce(F.concat(F.lit("\nSurviving mutants: "), F.col("survivors"), F.lit(".")), F.lit("")),
                F.coalesce(F.concat(F.lit("\nNot covered: "), base, F.lit(":"), F.col("ranges"), F.lit(".")), F.lit("")),
                F.lit("\nKill the survivors with focused tests first, then reduce complexity."),
            ).alias("body"),
        )
    )
    pm = packages.withColumnRenamed("package", "id").select(
        *ID, "crap_max", "worst", "stmts", "percent", "coverage_stale", "killed", "survived", "not_covered", "score"
    )
    pkg_text = (
        nodes.where(F.col("kind") == PACKAGE)
        .select(*ID, "name")
        .join(pm, ID, "left")
        .join(th, "repo", "left")
        .select(
            *ID,
            F.col("name").alias("target"),
            F.concat(
                F.lit("Improve package "),
                F.col("name"),
                F.lit(": CRAP max "),
                or_not_measured("crap_max", fixed1("crap_max")),
                F.coalesce(F.concat(F.lit(" ("), paths.short("worst"), F.lit(")")), F.lit("")),
                F.lit(", "),
                _coverage_target(limits[1]),
                F.lit(", "),
                _mutation_target(limits[2]),
                F.lit(
                    ".\nStart with the riskiest function, kill surviving mutants with focused tests, "
                    "then reduce complexity."
                ),
            ).alias("body"),
        )
    )
    type_text = nodes.where(F.col("kind") == TYPE).select(
        *ID,
        name.alias("target"),
        F.concat(
            F.lit("Review type "), name, F.lit(" ("), F.col("file"), F.lit(":"), _s("line"), F.lit(") and its usages.")
        ).alias("body"),
    )
    closing = F.concat(
        F.col("body"),
        F.coalesce(F.concat(F.lit("\n"), F.col("note_lines")), F.lit("")),
        F.lit(f"\nFrom the user: {message.strip()}" if message.strip() else ""),
        F.lit("\nVerify with: check "),
        F.col("target"),
    )
    with_tail = (
        func_text.unionByName(pkg_text)
        .unionByName(type_text)
        .join(joined_notes(placed_notes), ID, "left")
        .select(*ID, closing.alias("prompt"))
    )
    others = nodes.where(F.col("kind").isin(MODULE, EXTERNAL)).select(
        *ID, F.concat(F.lit("List every place the code imports "), F.col("name"), F.lit(".")).alias("prompt")
    )
    return with_tail.unionByName(others)
