from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from plumbline import schemas as S
from plumbline.sources import writers
from plumbline.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drain(df, path, mode="append"):
    """Run a stream to its end and return what it wrote."""
    spark = df.sparkSession
    q = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/cp")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def test_change_batches_equal_the_batch_twin(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"r{rnd.randrange(3)}", at(rnd.uniform(0, 4000)), rnd.choice(["a.go", "b_test.go", "c.md"]), rnd.choice(["write", "chmod"])) for _ in range(400)]
    rows.append(("late", at(90000), "z.go", "write"))
    df = spark.createDataFrame(rows, S.EDIT_EVENTS)
    df.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.EDIT_EVENTS).parquet(str(tmp_path / "in"))
    out = drain(feeds.change_batches(stream, "30 seconds"), str(tmp_path))
    twin = feeds.change_batches(df, "30 seconds").where("repo <> 'late'")
    cols = ["repo", "first", "last", "closed", "events"]
    assert pairs(out, *cols) == pairs(twin, *cols) and out.count() > 20


def test_liveness_equals_the_batch_twin(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"c{rnd.randrange(4)}", at(round(rnd.uniform(0, 6000), 1))) for _ in range(300)]
    rows += [("edge", at(0)), ("edge", at(60)), ("edge", at(121)), ("end", at(90000))]
    df = spark.createDataFrame(rows, S.ACTIVITY)
    df.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.ACTIVITY).parquet(str(tmp_path / "in"))
    out = drain(feeds.liveness_stream(stream), str(tmp_path)).where("client <> 'end'")
    twin = feeds.liveness_changes(df).where("client <> 'end'")
    assert pairs(out, "client", "ts", "connected") == pairs(twin, "client", "ts", "connected")
    state = dict(pairs(feeds.liveness_at(df, "2024-01-01 00:03:01"), "client", "connected"))
    assert state["edge"] is True


def test_new_notes_appear(spark, tmp_path):
    folder = tmp_path / "n" / "repo=a"
    folder.mkdir(parents=True)
    note = {"id": "n1", "target": "t", "author": "user", "text": "x", "created": "2024-01-01T00:00:00Z", "resolved": False}
    (folder / "1.json").write_text(json.dumps([note]))
    got = drain(feeds.new_notes(spark, str(tmp_path / "n")), str(tmp_path))
    assert pairs(got, "repo", "id") == [("a", "n1")]


def test_newly_stale_feed(spark, tmp_path):
    schema = "repo string, id string, cc int, coverage_stale boolean, mutation_stale boolean"
    before = spark.createDataFrame([("r", "a", 1, True, None), ("r", "b", 1, False, None)], schema)
    now = [("r", "a", 1, True, None), ("r", "b", 1, True, None), ("r", "c", None, True, None), ("r", "d", None, None, True)]
    spark.createDataFrame(now, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = feeds.newly_stale_feed(
        stream, lambda batch: before, lambda df, epoch: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"), availableNow=True
    )
    q.awaitTermination()
    assert sorted(seen) == ["b", "d"]


RESULT = "repo string, snapshot_id string, package string, error string, ran_at timestamp, id string, stmts long, covered long, line int, state string"
FUNCS = "repo string, snapshot_id string, id string, parent string, line int, body_hash string"


def test_coverage_upkeep(spark, tmp_path):
    f = spark.createDataFrame([("r", "s", "m/p.f", "m/p", 10, "h"), ("r", "s", "m/q.g", "m/q", 1, "h"), ("r2", "s", "m/z.f", "m/z", 1, "h")], FUNCS)
    root, src = str(tmp_path / "store"), str(tmp_path / "in")
    batches = [
        [("r", "s", "m/p", None, at(0), "m/p.f", 3, 2, 12, "covered"), ("r", "s", "m/p", None, at(0), "m/p.f", 3, 2, 13, "uncovered"), ("r", "s", "m/q", None, at(0), None, None, None, None, None), ("r2", "s", "m/z", None, at(0), "m/z.f", 1, 1, 1, "covered")],
        [("r", "s", "m/p", "tests failed", at(9), None, None, None, None, None)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(RESULT).parquet(src)
        feeds.coverage_upkeep(stream, root, f, str(tmp_path / "cp"), availableNow=True).awaitTermination()
        cache = writers.read_cache(spark, f"{root}/coverage_cache", S.COVERAGE_CACHE)
        want = [("m/p.f", 3), ("m/q.g", 0), ("m/z.f", 1)] if n == 0 else [("m/q.g", 0), ("m/z.f", 1)]
        assert pairs(cache, "id", "stmts") == want
    errors = writers.read_cache(spark, f"{root}/coverage_errors", S.COVERAGE_ERRORS, "package")
    assert pairs(errors, "package", "error") == [("m/p", "tests failed")]
    lines = writers.read_cache(spark, f"{root}/coverage_cache_lines", S.COVERAGE_CACHE_LINES)
    assert pairs(lines, "id", "line_offset") == [("m/z.f", 0)]


def test_upkeep_takes_the_latest_of_runs_that_come_together(spark, tmp_path):
    f = spark.createDataFrame([("r", "s", "m/p.f", "m/p", 10, "h"), ("r", "s", "m/q.g", "m/q", 1, "h")], FUNCS)
    root, src = str(tmp_path / "store"), str(tmp_path / "in")
    rows = [
        ("r", "s", "m/p", "tests failed", at(0), None, None, None, None, None),
        ("r", "s", "m/p", None, at(5), "m/p.f", 3, 1, 12, "covered"),
        ("r", "s", "m/q", None, at(2), "m/q.g", 9, 9, 2, "covered"),
        ("r", "s", "m/q", None, at(3), "m/q.g", 4, 2, 3, "uncovered"),
    ]
    spark.createDataFrame(rows, RESULT).coalesce(1).write.parquet(src)
    feeds.coverage_upkeep(spark.readStream.schema(RESULT).parquet(src), root, f, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    cache = writers.read_cache(spark, f"{root}/coverage_cache", S.COVERAGE_CACHE)
    assert pairs(cache, "id", "stmts", "covered", "ran_at") == [("m/p.f", 3, 1, at(5)), ("m/q.g", 4, 2, at(3))]
    assert writers.read_cache(spark, f"{root}/coverage_errors", S.COVERAGE_ERRORS, "package").count() == 0
    lines = writers.read_cache(spark, f"{root}/coverage_cache_lines", S.COVERAGE_CACHE_LINES)
    assert pairs(lines, "id", "line_offset", "state") == [("m/p.f", 2, "covered"), ("m/q.g", 2, "uncovered")]


MRESULT = "repo string, snapshot_id string, package string, engine string, engine_version string, ran_at timestamp, error string, id string, line int, col int, type string, status string, description string"


@pytest.mark.parametrize("fail", [False, True])
def test_mutation_upkeep(spark, tmp_path, fail):
    f = spark.createDataFrame([("r", "s", "m/p.f", "m/p", 10, "h"), ("r", "s", "m/p.g", "m/p", 30, "h")], FUNCS)
    root, src = str(tmp_path / "store"), str(tmp_path / "in")
    head = ("r", "s", "m/p", "e", "1")
    first = [(*head, at(0), None, "m/p.f", 12, 1, "X", "LIVED", "d"), (*head, at(0), None, "m/p.f", 12, 2, "X", "KILLED", "d")]
    second = [(*head, at(5), "preflight" if fail else None, None, None, None, None, None, None)]
    for rows in [first, second]:
        spark.createDataFrame(rows, MRESULT).coalesce(1).write.mode("append").parquet(src)
        feeds.mutation_upkeep(spark.readStream.schema(MRESULT).parquet(src), root, f, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    cache = writers.read_cache(spark, f"{root}/mutation_cache", S.MUTATION_CACHE)
    assert pairs(cache, "id", "killed", "survived") == [("m/p.f", int(fail), int(fail)), ("m/p.g", 0, 0)]
    runs = writers.read_cache(spark, f"{root}/mutation_runs", S.MUTATION_RUNS, "package")
    assert pairs(runs, "package", "error") == [("m/p", "preflight" if fail else None)]
    kept = writers.read_cache(spark, f"{root}/mutation_cache_mutants", S.MUTATION_CACHE_MUTANTS)
    assert kept.count() == (2 if fail else 0)
    assert kept.where(F.col("line_offset") != 2).count() == 0
