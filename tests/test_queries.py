"""Every registered query against its SQL twin in DuckDB, on the smallest data folder."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) and math.isfinite(v) else str(v)) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(_same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert row.total_records == row.high_risk_count + row.medium_risk_count + row.low_risk_count + row.errors
