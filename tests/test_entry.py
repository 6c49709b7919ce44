"""The registry, and some of its queries against their SQL on the small tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from verify import rows

DATA = Path("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(entry.bench_queries.QUERIES) == set(entry.bench_queries.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.is_dir(), reason="supplied tables are not here")
@pytest.mark.parametrize("name", ["function_coverage", "tally_mutants", "resolve_ids", "change_batches", "place_notes"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = entry.queries()[name](spark, str(DATA))
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
