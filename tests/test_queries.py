"""Every query with SQL gives the same rows as DuckDB over the same tables; the others run and keep their columns."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n[:1] == "p" or not n[1:2].isdigit() or n in ORACLES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    rows = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        got = db.sql(ORACLES[name])
        assert sorted(got.columns) == columns
        at = [got.columns.index(c) for c in columns]
        assert rows == sorted(tuple(canon(r[k]) for k in at) for r in got.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
