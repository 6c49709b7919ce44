"""Session settings and the one way this library cuts lineage.

Everything iterative writes its rounds as Parquet below the cluster's
``spark.checkpoint.dir``, so a lost executor only repeats the current round.
"""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the jobs are designed for. They are ordinary session
# settings: a cluster may override any of them.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # No broadcasts by estimated size: before a job the planner only knows how
    # large a file is compressed, and rows of repeated names grow thirtyfold in
    # the driver. Nor by the measured size of a shuffle: both sides have moved by
    # then, that size is compressed too, and a loop would send every round's new
    # rows through the driver. What is proven small is broadcast by name.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins here are often followed by an aggregate on the same key; without
    # this flag the skew split is given up to save that second shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions are merged in every task first, so that a busy repository sends
    # its sessions through the shuffle and not its events.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session that someone else built."""
    for k, v in SQL_SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``_`` for ``.``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SQL_SETTINGS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-plumbline-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def sweep_intermediates(spark: SparkSession, older_than_seconds: float = 7 * 24 * 3600.0) -> list[str]:
    """Remove the written intermediates of jobs that ended long ago: those folders of
    ``settle`` and ``Rounds`` in which nothing has changed for the given time,
    which must exceed the longest job. Returns their names."""
    from plumbline.sources.store import Files

    root = f"{shared_folder(spark)}/plumbline"
    files = Files(spark, root)
    limit = time.time_ns() // 1_000_000 - int(older_than_seconds * 1000)
    old = []
    for name, changed in files.children(root):
        newest = max([changed, *(at for _, at in files.children(f"{root}/{name}"))])
        if newest <= limit:
            files.remove(f"{root}/{name}")
            old.append(name)
    return sorted(old)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and the planner knows the real size of what it reads."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def joined_by_some_keys(spark: SparkSession):
    """Joins planned inside need not be dealt by all of their keys, if both sides lie by the same some."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def kept_by(df: DataFrame, *keys: str):
    """``df`` dealt by its keys and kept by the executors, in memory and on disk, as long as a loop lasts:
    its rounds join it where it lies. Lineage is not cut; what is lost with an executor is made again."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(parts, *keys).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


class Rounds:
    """The written rounds of an iteration: ``<folder>/round=<i>``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = new_folder(spark, label)
        self.count = 0
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        """Write one round and read it back."""
        if self.schema is None:
            self.schema = df.schema
        path = f"{self.folder}/round={self.count}"
        df.write.mode("overwrite").parquet(path)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """Every row of every round, with its ``round`` number."""
        from pyspark.sql.types import IntegerType, StructField, StructType

        schema = StructType(list(self.schema.fields) + [StructField("round", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.folder)


def spread_join(
    rows: DataFrame, few: DataFrame, keys: list[str], by: list[str], salts: int = 1, how: str = "inner"
) -> DataFrame:
    """Join many rows to a side with few rows per key.

    Adaptive execution splits a partition that one key makes too large, into
    as many pieces as its size asks for, and broadcasts ``few`` when it is
    small. Where it is switched off, ``salts`` > 1 spreads the rows of each
    key by the columns ``by`` and lists ``few`` once per salt.
    """
    if salts <= 1:
        return rows.join(few, keys, how)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
