"""Every catalog query against its DuckDB SQL at the smallest size, and the entry query."""

import glob
import os

import pytest

import __spark_entry__
from granary.plans import catalog_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, duck, name):
    got = catalog_queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    sql = catalog_queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = [dict(zip(names, r)) for r in rel.fetchall()]
    assert rows == sorted(repr(tuple(r[c] for c in cols)) for r in want)
