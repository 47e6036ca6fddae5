"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from fragmenta.plans import core_queries, io_queries, period_queries

DATA = Path("/root/testdata/sf0.001")
QUERIES = core_queries.QUERIES | period_queries.QUERIES | io_queries.QUERIES
ORACLE = core_queries.ORACLE | period_queries.ORACLE | io_queries.ORACLE


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v) if not isinstance(v, list) else [plain(x) for x in v]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in df.collect())
    if name in ORACLE:
        found = duck.sql(ORACLE[name])
        assert sorted(found.columns) == cols
        at = [found.columns.index(c) for c in cols]
        assert rows == sorted([plain(r[i]) for i in at] for r in found.fetchall())
