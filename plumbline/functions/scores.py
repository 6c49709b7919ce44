"""Risk, percentages and grades as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schemas import NOT_COVERED  # noqa: F401  (re-exported for callers)

# Fixed values: (limit, grade), best first.
CRAP_STEPS = [(5, 10), (8, 8), (12, 6), (20, 4), (30, 2)]
MUTATION_STEPS = [(90, 10), (80, 8), (70, 6), (55, 4), (40, 2)]
COVERAGE_STEPS = [(90, 10), (80, 8), (70, 6), (50, 4), (30, 2)]
# Lowest grade of each severity band, best first.
BAND_STEPS = [(9, 5), (7, 4), (5, 3), (3, 2)]
# Lowest combined grade that is shown green.
GREEN = 9
# The grade of a function that has no statements left to test.
NOTHING_UNTESTED = 10
WORST = 1


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round1(v: Column) -> Column:
    """One decimal, halves away from zero, on the binary value times ten."""
    t = v * F.lit(10.0)
    return F.signum(t) * F.floor(F.abs(t) + F.lit(0.5)) / F.lit(10.0)


def ratio(part: Column | str, total: Column | str) -> Column:
    p, t = _c(part).cast("double"), _c(total).cast("double")
    return F.when(t != 0, p / t)


def coverage_percent(covered: Column | str, stmts: Column | str) -> Column:
    """Covered share of statements in percent; NULL without statements."""
    return F.floor(ratio(covered, stmts) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def percent(part: Column | str, total: Column | str) -> Column:
    return round1(ratio(part, total) * F.lit(100.0))


def mutation_score(killed: Column | str, timed_out: Column | str, survived: Column | str) -> Column:
    """Caught mutants in percent; a time-out counts as caught."""
    caught = _c(killed) + _c(timed_out)
    return percent(caught, caught + _c(survived))


def run_efficacy(killed: Column | str, survived: Column | str) -> Column:
    """The share a run prints: time-outs are left out on both sides."""
    return ratio(killed, _c(killed) + _c(survived)) * F.lit(100.0)


def crap(cc: Column | str, stmts: Column | str, covered: Column | str) -> Column:
    """cc² × (1 − coverage)³ + cc on the exact ratio.

    ``stmts`` NULL means coverage was never measured, and the result is NULL;
    zero statements count as fully covered.
    """
    cc, stmts = _c(cc).cast("double"), _c(stmts)
    cov = F.when(stmts == 0, F.lit(1.0)).otherwise(ratio(covered, stmts))
    miss = F.lit(1.0) - cov
    return cc * cc * (miss * miss * miss) + cc


def step_grade(value: Column, steps: list[tuple[float, int]], low_is_good: bool, otherwise: int = WORST) -> Column:
    """The grade of the first limit ``value`` is on the good side of."""
    first, *rest = [((value <= lim) if low_is_good else (value >= lim), g) for lim, g in steps]
    chain = reduce(lambda c, s: c.when(*s), rest, F.when(*first))
    return chain.otherwise(F.lit(otherwise))


def grade_crap(v: Column | str) -> Column:
    return step_grade(_c(v), CRAP_STEPS, low_is_good=True)


def grade_mutation(v: Column | str) -> Column:
    return step_grade(_c(v), MUTATION_STEPS, low_is_good=False)


def grade_coverage(stmts: Column | str, pct: Column | str) -> Column:
    """Unmeasured is worst; measured but without statements is best."""
    return (
        F.when(_c(stmts).isNull(), F.lit(WORST))
        .when(_c(pct).isNull(), F.lit(NOTHING_UNTESTED))
        .otherwise(step_grade(_c(pct), COVERAGE_STEPS, low_is_good=False))
    )


def mutation_graded(measured: Column, score: Column | str, testable_not_covered: Column | str) -> Column:
    """Missing data is graded (as worst); no testable site is left out."""
    return ~measured | _c(score).isNotNull() | (F.coalesce(_c(testable_not_covered), F.lit(0)) > 0)


def combined(crap_grade: Column | str, mutation_grade: Column | str) -> Column:
    """Mean of both grades, half up; the CRAP grade where mutation is left out."""
    c, m = _c(crap_grade), _c(mutation_grade)
    return F.when(m.isNull(), c).otherwise(F.floor((c + m + F.lit(1)) / F.lit(2)).cast("int"))


def sites(killed: Column | str, survived: Column | str, not_covered: Column | str, timed_out: Column | str) -> Column:
    return _c(killed) + _c(survived) + _c(not_covered) + _c(timed_out)


def worst_of(a: Column, b: Column) -> Column:
    """Lower of two grades; a NULL grade does not apply and loses."""
    return F.least(a, b)


def severity_band(grade: Column | str) -> Column:
    """Grade 1..10 to a band 1..5."""
    return step_grade(_c(grade), BAND_STEPS, low_is_good=False)


GRADE_MODES = {
    "combined": "grade_combined",
    "crap": "grade_crap",
    "coverage": "grade_coverage",
    "mutation": "grade_mutation",
}


def grade_by_mode(mode: Column | str) -> Column:
    """The grade column that colours a box in the given mode, row by row."""
    m = _c(mode)
    return F.coalesce(*[F.when(m == name, F.col(col)) for name, col in GRADE_MODES.items()])


def timeout_factor(baseline_seconds: Column | str) -> Column:
    """Factor on the baseline that leaves 15 s more than it, at least 3."""
    b = _c(baseline_seconds).cast("double")
    b = F.when(b <= 0, F.lit(1.0)).otherwise(b)
    return F.greatest(F.lit(3), F.ceil((b + F.lit(15.0)) / b).cast("int"))


def untested(percent_col: Column | str, stmts: Column | str) -> Column:
    return F.coalesce((_c(percent_col) == 0) & (_c(stmts) > 0), F.lit(False))
