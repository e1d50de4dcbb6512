"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sondeframe.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return own


def text(row) -> str:
    return str(tuple(repr(x) if isinstance(x, float) else str(x) for x in row))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    want = con.sql(ORACLE_SQL[name])
    out = QUERIES[name](spark, DATA)
    assert sorted(out.columns) == sorted(want.columns)
    got = sorted(text(r) for r in out.select(*[f"`{c}`" for c in want.columns]).collect())
    assert got == sorted(text(r) for r in want.fetchall()) and got


SLOW = {"gaussian_mixture", "component_scan", "seed_sweep", "two_stage", "k_scan", "tree_scan"}  # fits, which other tests run


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
