"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import math
import os
import re

import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]
# queries that SQL does not express have brute-force tests of their own
NO_SQL = re.compile(r"op\d+_|pipeline$")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    rows = [tuple(_norm(col[i]) for col in data) for i in range(table.num_rows)]
    return cols, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck(sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "device_health_score" in df.columns


def test_every_query_has_an_oracle_or_is_exempt():
    missing = set(entry.queries()) - set(entry.oracle_sql())
    assert all(NO_SQL.match(name) for name in missing)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_matches_oracle(spark, duck, sf_small, name):
    got = entry.queries()[name](spark, sf_small).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
