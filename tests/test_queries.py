"""Every query with SQL gives what DuckDB gives; the others have rows and a stable schema."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.OWN))
def test_query(spark, con, name):
    a = entry.queries()[name](spark, D).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(a)
        return
    b = con.execute(sql).fetchdf()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["node_id", "dist", "hops"] and df.count() > 0


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
