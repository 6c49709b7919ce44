"""Helpers that several operators of this package share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import settle

# A side of a join is sent to every task only when its written size, counted
# first, is below this many bytes; beyond it the join is an ordinary one.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a settled table) marked for broadcast when its counted rows prove it small."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def hex_long(x: str, digits: int = 15) -> F.Column:
    """The first hexadecimal digits of a digest as a non-negative long."""
    return F.conv(F.substring(x, 1, digits), 16, 10).cast("long")


def one_thread() -> None:
    """Native libraries in a task use the one core that Spark gave it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["OMP_NUM_THREADS"] = "1"


__all__ = ["BROADCAST_BYTES", "hex_long", "one_thread", "settle", "small", "table"]
