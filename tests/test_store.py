from __future__ import annotations

import time

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from conftest import pairs
from plumbline import schemas as S
from plumbline import session
from plumbline.sources import writers
from plumbline.sources.store import Conflict, Files, Store

ROWS = StructType([StructField("repo", StringType()), StructField("id", StringType()), StructField("v", LongType())])
TABLES = ("a", "b", "c")


def frames(spark, value, repos=("r1", "r2")):
    rows = [(r, f"i{k}", value) for r in repos for k in range(3)]
    return {t: spark.createDataFrame(rows, ROWS) for t in TABLES}, spark.createDataFrame([(r,) for r in repos], "repo string")


def values(store, version=None):
    """What each table holds: (repo, value) pairs; equal in all tables or the version is torn."""
    got = [sorted({(r.repo, r.v) for r in store.read(t, ROWS, version).collect()}) for t in TABLES]
    assert got[0] == got[1] == got[2]
    return got[0]


def test_commit_replaces_keys_in_all_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert values(store) == [] and store.version().number == 0
    first = store.commit(*frames(spark, 1), store.version())
    store.commit(*frames(spark, 2, ["r2"]), store.version())
    assert values(store) == [("r1", 1), ("r2", 2)]
    assert values(store, first) == [("r1", 1), ("r2", 1)]  # a reader's version stays
    store.commit({t: df.limit(0) for t, df in frames(spark, 0)[0].items()}, frames(spark, 0, ["r1"])[1], store.version())
    assert values(store) == [("r2", 2)]


@pytest.mark.parametrize("place", ["a", "b", "c", "keys", "number"])
def test_a_crash_between_any_two_writes_leaves_the_old_version(spark, tmp_path, monkeypatch, place):
    store = Store(spark, str(tmp_path))
    store.commit(*frames(spark, 1), store.version())

    def rows(self, write, table, df, real=Store.write_rows):
        if table == place:
            raise OSError("crash")
        real(self, write, table, df)

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(Store, "write_rows", rows)
        if place == "keys":
            m.setattr(Store, "write_keys", crash)
        if place == "number":
            m.setattr(Store, "take_number", crash)
        with pytest.raises(OSError, match="crash"):
            store.update(lambda _: frames(spark, 2), ("s", 0))
    assert values(store) == [("r1", 1), ("r2", 1)]
    store.update(lambda _: frames(spark, 2), ("s", 0))
    assert values(store) == [("r1", 2), ("r2", 2)]
    assert len(store.sweep(0)) == 1 + (place != TABLES[0])  # the first write, and what the crash left
    assert values(store) == [("r1", 2), ("r2", 2)]


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.update(lambda _: frames(spark, 1), ("s", 4))
    assert store.update(lambda _: frames(spark, 9), ("s", 4)).number == one.number
    store.update(lambda _: frames(spark, 2), ("other", 0))
    assert store.update(lambda _: frames(spark, 9), ("s", 3)).number == one.number + 1
    assert values(store) == [("r1", 2), ("r2", 2)]


def test_of_two_writers_one_retries(spark, tmp_path):
    store, other, bases = Store(spark, str(tmp_path)), Store(spark, str(tmp_path)), []

    def build(base):
        bases.append(base.number)
        if len(bases) == 1:  # another writer comes in between
            other.commit(*frames(spark, 5), other.version())
        was = {r: v for r, v in values(store, base)}.get("r1", 0)
        return frames(spark, was + 1, ["r1"])

    store.update(build)
    assert bases == [0, 1] and values(store) == [("r1", 6), ("r2", 5)]
    base = store.version()
    other.commit(*frames(spark, 7, ["r2"]), other.version())
    store.commit(*frames(spark, 8, ["r1"]), base)  # another key: no conflict
    with pytest.raises(Conflict):
        store.commit(*frames(spark, 9, ["r2"]), base)
    assert values(store) == [("r1", 8), ("r2", 7)]


def test_a_number_is_taken_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.put(f"{tmp_path}/x", "1")
    files.put(f"{tmp_path}/y", "2")
    assert files.rename_new(f"{tmp_path}/x", f"{tmp_path}/z")
    assert not files.rename_new(f"{tmp_path}/y", f"{tmp_path}/z")
    assert files.read(f"{tmp_path}/z") == "1"


def size(path):
    return sum(p.stat().st_size for t in TABLES for p in (path / t).rglob("*.parquet"))


def test_retention(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit(*frames(spark, 0), store.version())
    one = size(tmp_path)
    for k in range(1, 11):
        reader = store.read("a", ROWS)  # planned before the rewrite
        store.commit(*frames(spark, k), store.version())
        assert store.sweep(3600) == []  # the reader's lease
        assert {r.v for r in reader.collect()} == {k - 1}
        store.sweep(0)
    assert size(tmp_path) < 2 * one and values(store) == [("r1", 10), ("r2", 10)]
    assert store.version().number == 11


def test_thin_writes_are_moved(spark, tmp_path):
    store = Store(spark, str(tmp_path), ("repo", "snapshot_id"))
    schema = StructType([*ROWS.fields, StructField("snapshot_id", StringType())])

    def put(value, snaps):
        df = spark.createDataFrame([("r", f"i{value}", value, s) for s in snaps], schema)
        store.commit({"a": df}, df.select("repo", "snapshot_id"), store.version())

    put(1, ["007", "08", "1e3"])
    put(2, ["08", "1e3"])
    assert len(store.sweep(0)) == 1
    assert pairs(store.read("a", schema), "snapshot_id", "v") == [("007", 1), ("08", 2), ("1e3", 2)]


def test_snapshots_do_not_follow_clocks(spark, tmp_path, monkeypatch):
    rows = lambda v: {"nodes": spark.createDataFrame([("r", "s", v, "func")], "repo string, snapshot_id string, id string, kind string")}
    writers.write_snapshot(rows("first"), str(tmp_path))
    monkeypatch.setattr(time, "time_ns", lambda: 1)
    writers.write_snapshot(rows("second"), str(tmp_path))
    got = writers.read_table(spark, str(tmp_path), "nodes", StructType([f for f in S.NODES if f.name in ("repo", "snapshot_id", "id", "kind")]))
    assert pairs(got, "id") == [("second",)]


def test_intermediates_are_swept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    kept = session.settle(spark.range(3), "kept")
    assert session.sweep_intermediates(spark, 3600) == [] and kept.count() == 3
    session.settle(spark.range(2), "swept-away")
    assert any(n.startswith("swept-away") for n in session.sweep_intermediates(spark, 0))
