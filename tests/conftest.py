"""Shared fixtures: one local Spark session and a DuckDB connection over the
driver tables, as the correctness gate uses them."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tessella.session import TABLES, build_session  # noqa: E402

SF_DIR = os.environ.get("TESSELLA_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    wh = str(tmp_path_factory.mktemp("warehouse"))
    s = build_session("local[8]", app="tessella-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


@pytest.fixture()
def scratch(tmp_path):
    """A fresh folder per test (pytest's own temporary area)."""
    return str(tmp_path)
