"""Streams: change batches, liveness, staleness and cache upkeep.

Event time is this library's addition: rows later than the watermark are
dropped. Each stateful stream has a batch twin with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from plumbline import schemas as S
from plumbline.functions import paths
from plumbline.operators.metrics import newly_stale
from plumbline.operators.mutation import count_mutants
from plumbline.sources.writers import update_coverage_caches, update_mutation_caches

WATERMARK = "10 minutes"
# Quiet period after a change, and how long a ping counts.
QUIET = "300 milliseconds"
ALIVE_SECONDS = 60


def relevant(events: DataFrame) -> DataFrame:
    """Changes of Go sources that call for a new scan; a bare change of
    permissions does not. ``events``: ``repo, ts, file, op``."""
    base = F.substring_index("file", "/", -1)
    return events.where(paths.is_checked_go_file(base) & (F.col("op") != "chmod"))


def change_batches(events: DataFrame, quiet: str = QUIET, watermark: str = WATERMARK) -> DataFrame:
    """One row per repository and burst of changes: a burst ends after a quiet
    period. The same expression serves a stream and a table."""
    rows = relevant(events)
    if events.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    return (
        rows.groupBy("repo", F.session_window("ts", quiet).alias("w"))
        .agg(F.count("*").alias("events"), F.max("ts").alias("last"))
        .select("repo", F.col("w.start").alias("first"), "last", F.col("w.end").alias("closed"), "events")
    )


# --- liveness ---------------------------------------------------------------


class _Liveness(StatefulProcessor):
    """Remembers each client's last ping and reports changes only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f["ts"].to_numpy().astype("datetime64[ms]").astype("int64") for f in rows]
        pings = np.unique(np.concatenate(frames))
        last = self.last.get()[0] if self.last.exists() else None
        limit = ALIVE_SECONDS * 1000
        known = pings if last is None else pings[pings > last]
        line = known if last is None else np.concatenate([[last], known])
        # Positions after which the client was silent for too long.
        cut = np.flatnonzero(np.diff(line) > limit)
        gone, back = line[cut] + limit, line[cut + 1]
        if last is None:
            back = np.concatenate([line[:1], back])
        out = pd.DataFrame({"ts": np.concatenate([gone, back]), "connected": [False] * len(gone) + [True] * len(back)})
        out.insert(0, "client", key[0])
        out["ts"] = pd.to_datetime(out["ts"], unit="ms")
        last = int(line[-1])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((last,))
        self.handle.registerTimer(last + limit)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        gone = pd.Timestamp(last + ALIVE_SECONDS * 1000, unit="ms")
        yield pd.DataFrame([(key[0], gone, False)], columns=["client", "ts", "connected"])

    def close(self) -> None:
        pass


def liveness_stream(activity: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Connection changes of each client (``client, ts`` pings) as they happen.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return (
        activity.withWatermark("ts", watermark)
        .groupBy("client")
        .transformWithStateInPandas(
            statefulProcessor=_Liveness(),
            outputStructType="client string, ts timestamp, connected boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def liveness_changes(activity: DataFrame) -> DataFrame:
    """Batch twin: a client connects with the first ping of a session and
    disconnects the limit after its last; a ping exactly at the limit counts."""
    ms = F.date_trunc("millisecond", "ts")
    s = (
        activity.select("client", ms.alias("ts"))
        .groupBy("client", F.session_window("ts", f"{ALIVE_SECONDS} seconds 1 milliseconds").alias("w"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    )
    up = s.select("client", F.col("first").alias("ts"), F.lit(True).alias("connected"))
    down = s.select(
        "client",
        (F.col("last") + F.expr(f"INTERVAL {ALIVE_SECONDS} SECONDS")).alias("ts"),
        F.lit(False).alias("connected"),
    )
    return up.unionByName(down)


def liveness_at(activity: DataFrame, as_of: str) -> DataFrame:
    """State of every client at a moment: ``client, last_seen, connected``."""
    at = F.to_timestamp(F.lit(as_of))
    return (
        activity.where(F.col("ts") <= at)
        .groupBy("client")
        .agg(F.max("ts").alias("last_seen"))
        .withColumn("connected", F.col("last_seen") >= at - F.expr(f"INTERVAL {ALIVE_SECONDS} SECONDS"))
    )


# --- feeds ------------------------------------------------------------------


def new_files(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Files that other processes write (notes, snapshots), as they appear."""
    full = StructType([*schema.fields, *[StructField(k, StringType()) for k in keys]])
    return spark.readStream.schema(full).option("multiLine", True).option("basePath", path).json(path)


def new_notes(spark: SparkSession, path: str) -> DataFrame:
    return new_files(spark, path, S.NOTE_JSON, ["repo"])


def newly_stale_feed(
    metrics: DataFrame,
    last_metrics: Callable[[DataFrame], DataFrame],
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """For each micro-batch of new metrics, hand ``emit`` the functions that
    became stale. ``last_metrics(batch)`` gives the committed metrics of the
    same repositories before the batch."""

    def apply(batch: DataFrame, epoch: int) -> None:
        emit(newly_stale(last_metrics(batch), batch), epoch)

    return metrics.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _latest(results: DataFrame) -> DataFrame:
    """The rows of each package's latest run, of those that came in together."""
    pkg = ["repo", "package"]
    return results.join(results.groupBy(*pkg).agg(F.max("ran_at").alias("ran_at")), [*pkg, "ran_at"], "left_semi")


def coverage_upkeep(
    results: DataFrame, root: str, funcs: DataFrame, checkpoint: str, name: str = "coverage", **trigger
) -> StreamingQuery:
    """Keep stored coverage caches current from a stream of run results:
    ``repo, snapshot_id, package, error, ran_at, id, stmts, covered, line,
    state`` (one row per measured line; ``id`` NULL for a package that ran
    without measured functions). A micro-batch that is played again, under the
    stream's ``name``, changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        b = _latest(batch).persist()
        try:
            ran = b.groupBy("repo", "package").agg(F.max("ran_at").alias("ran_at"))
            failed = b.where("error IS NOT NULL").groupBy("repo", "package").agg(F.max("error").alias("error"))
            measured = (
                b.where("id IS NOT NULL")
                .groupBy(*S.SNAP, "id")
                .agg(F.max("stmts").alias("stmts"), F.max("covered").alias("covered"))
            )
            states = b.where("line IS NOT NULL").select(*S.SNAP, "id", "line", "state").distinct()
            touched = funcs.join(b.select(*S.SNAP).distinct(), S.SNAP, "left_semi")
            update_coverage_caches(spark, root, touched, measured, states, ran, failed, epoch=(name, epoch))
        finally:
            b.unpersist()

    return results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def mutation_upkeep(
    results: DataFrame, root: str, funcs: DataFrame, checkpoint: str, name: str = "mutation", **trigger
) -> StreamingQuery:
    """Keep stored mutation caches current from a stream of run results:
    ``repo, snapshot_id, package, engine, engine_version, ran_at, error, id,
    line, col, type, status, description`` (one row per mutant; ``id`` NULL for
    a package without mutants). Replays change nothing, as above."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        b = _latest(batch).persist()
        try:
            outcome = b.groupBy("repo", "package").agg(
                F.max("engine").alias("engine"),
                F.max("engine_version").alias("engine_version"),
                F.max("ran_at").alias("ran_at"),
                F.max("error").alias("error"),
            )
            touched = funcs.join(
                b.select(*S.SNAP, F.col("package").alias("parent")).distinct(), [*S.SNAP, "parent"], "left_semi"
            )
            mutants = b.where("id IS NOT NULL AND line IS NOT NULL").select(
                *S.SNAP, "id", "line", "col", "type", "status", "description"
            )
            update_mutation_caches(spark, root, touched, count_mutants(touched, mutants), mutants, outcome, (name, epoch))
        finally:
            b.unpersist()

    return results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


