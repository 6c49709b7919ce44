from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        "local[8]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_driver_memory="4g",
        spark_sql_streaming_stateStore_providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def pairs(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
