"""Commit history: churn per file and directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import dirname


def in_window(commit_files: DataFrame, as_of: str | None, months: int = 12) -> DataFrame:
    """Commits of the last ``months`` months before ``as_of`` (never the clock);
    all commits without ``as_of``, for a log that is already limited."""
    if as_of is None:
        return commit_files
    since = F.to_timestamp(F.lit(as_of)) - F.make_ym_interval(F.lit(0), F.lit(months))
    return commit_files.where(F.col("ts") >= since)


def file_churn(commit_files: DataFrame, as_of: str | None, months: int = 12) -> DataFrame:
    """Commits per file: ``repo, file, churn``."""
    return (
        in_window(commit_files, as_of, months)
        .groupBy("repo", "file")
        .agg(F.count_distinct("commit").alias("churn"))
    )


def directory_churn(commit_files: DataFrame, as_of: str | None, months: int = 12) -> DataFrame:
    """Commits that touched any file directly in a directory, once each."""
    return (
        in_window(commit_files, as_of, months)
        .groupBy("repo", dirname("file").alias("dir"))
        .agg(F.count_distinct("commit").alias("churn"))
    )
