"""Writers: snapshots and caches, in tables that change together (``store``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import schemas as S
from plumbline.operators.coverage import update_coverage_cache
from plumbline.operators.mutation import record_run
from plumbline.schemas import SNAP
from plumbline.session import settle
from plumbline.sources.store import Store, Version


def snapshot_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, tuple(SNAP))


def write_snapshot(tables: dict[str, DataFrame], root: str) -> Version:
    """Write all tables of some snapshots as one commit.

    Nothing that is there is touched, and readers see all tables of one version
    or none; a table without rows is empty in the new version, whatever the old one
    had. Of two writers of one snapshot the one that commits later counts,
    whatever their clocks say.
    """
    done = tables["snapshots"] if "snapshots" in tables else next(iter(tables.values()))
    keys = done.select(*SNAP).distinct()
    return snapshot_store(done.sparkSession, root).update(lambda _: (tables, keys))


def committed(spark: SparkSession, root: str) -> DataFrame | None:
    """Committed snapshots with their newest write, or None before the first one."""
    return snapshot_store(spark, root).live()


def read_table(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """A table, limited to the newest versions of committed snapshots."""
    return snapshot_store(spark, root).read(name, schema)


def read_cache(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """Cache rows; empty before the first write."""
    root, _, name = path.rstrip("/").rpartition("/")
    return Store(spark, root).read(name, schema).where(F.col(key).isNotNull())


def _update(
    store: Store,
    tables: list[tuple[str, StructType]],
    touched: DataFrame,
    apply: Callable[..., tuple[DataFrame, ...]],
    epoch: tuple[str, int] | None,
) -> None:
    """Replace the touched repositories' rows by what ``apply`` makes of them."""

    def build(base: Version) -> tuple[dict[str, DataFrame], DataFrame]:
        old = [store.read(n, s, base).join(touched, "repo", "left_semi") for n, s in tables]
        new = [settle(df.select(*s.fieldNames()), n) for df, (n, s) in zip(apply(*old), tables, strict=True)]
        return {n: df.join(touched, "repo", "left_semi") for df, (n, _) in zip(new, tables, strict=True)}, touched

    store.update(build, epoch)


def update_coverage_caches(
    spark: SparkSession,
    root: str,
    funcs: DataFrame,
    measured: DataFrame,
    states: DataFrame,
    ran: DataFrame,
    failed: DataFrame,
    at=None,
    epoch: tuple[str, int] | None = None,
) -> None:
    """Apply a coverage run to the stored caches of its repositories, in one commit.

    After a conflict with another writer the run is applied to the newer caches;
    an ``epoch`` (stream, number) that was committed before changes nothing."""
    stored = [
        ("coverage_cache", S.COVERAGE_CACHE),
        ("coverage_cache_lines", S.COVERAGE_CACHE_LINES),
        ("coverage_errors", S.COVERAGE_ERRORS),
    ]
    touched = ran.select("repo").distinct()
    apply = lambda *old: update_coverage_cache(*old, funcs, measured, states, ran, failed, at)
    _update(Store(spark, root), stored, touched, apply, epoch)


def update_mutation_caches(
    spark: SparkSession,
    root: str,
    funcs: DataFrame,
    mutation: DataFrame,
    mutants: DataFrame,
    outcome: DataFrame,
    epoch: tuple[str, int] | None = None,
) -> None:
    """Apply a mutation run to the stored caches of its repositories, as ``update_coverage_caches`` does."""
    stored = [
        ("mutation_cache", S.MUTATION_CACHE),
        ("mutation_cache_mutants", S.MUTATION_CACHE_MUTANTS),
        ("mutation_runs", S.MUTATION_RUNS),
    ]
    touched = outcome.select("repo").distinct()
    _update(Store(spark, root), stored, touched, lambda *old: record_run(*old, funcs, mutation, mutants, outcome), epoch)
