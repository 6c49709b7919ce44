"""The gate over a scope of functions, and from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators import coverage, gate, scopes
from plumbline.schemas import SNAP
from plumbline.session import settle


def check(
    functions: DataFrame,
    mutants: DataFrame | None,
    line_states: DataFrame | None,
    thresholds: DataFrame | None = None,
    critical_paths: DataFrame | None = None,
    scope: DataFrame | None = None,
    coverage_errors: DataFrame | None = None,
    placed_notes: DataFrame | None = None,
    fast: bool = False,
) -> dict[str, DataFrame]:
    """``breaches``, ``details``, ``rows``, ``not_measured``, ``summary``,
    ``verdict`` and ``notes`` for the functions in scope (None: all). Without
    ``mutants`` there are no ``details``; the fast mode needs neither them nor states."""
    m = gate.in_scope(functions, scope)
    limits = scopes.with_effective_thresholds(functions, thresholds)
    critical = None if critical_paths is None else scopes.files_matching(m, critical_paths)
    uncovered = None if line_states is None else coverage.state_runs(line_states, "uncovered")
    over = gate.breaches(m, limits, critical, uncovered, fast)
    bare = gate.breaches(m, limits, critical, None, fast)  # the verdict counts them and needs no hint
    missing = gate.not_measured(m, coverage_errors, fast)
    out = {
        "breaches": over,
        "rows": gate.report_rows(m),
        "not_measured": missing,
        "summary": gate.not_measured_summary(missing),
        "verdict": gate.verdict(m, bare),
    }
    if mutants is not None:
        out["details"] = gate.survivor_details(over, mutants, m)
    if placed_notes is not None:
        out["notes"] = gate.scope_notes(placed_notes, m.select(*SNAP, "id"))
    return out


def check_change(
    before: dict[str, DataFrame] | None,
    functions: DataFrame,
    line_states: DataFrame,
    thresholds: DataFrame | None = None,
    critical_paths: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The gate over all functions of new snapshots, from the result ``before`` (None: there is none).

    ``breaches`` and ``inputs`` are written tables, to be handed to the next call; ``changes`` tells which
    breaches appeared, were resolved or kept; ``verdict`` is as in :func:`check`. Each table holds one
    snapshot of a repository. Repositories without a function now lose their breaches.
    """
    limits = scopes.with_effective_thresholds(functions, thresholds)
    critical = None if critical_paths is None else scopes.files_matching(functions, critical_paths)
    inputs = settle(gate.breach_inputs(functions, limits, line_states, critical), "breach-inputs")
    if before is None:
        over = gate.breaches(functions, limits, critical, coverage.state_runs(line_states, "uncovered"))
        before = {"breaches": over.limit(0)}
    else:
        over = gate.renewed_breaches(before["breaches"], before["inputs"], inputs, functions, limits, line_states, critical)
    over = settle(over, "breaches")
    changes = gate.breach_changes(before["breaches"], over)
    return {"breaches": over, "inputs": inputs, "changes": changes, "verdict": gate.verdict(functions, over)}
