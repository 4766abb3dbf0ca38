"""Every query with SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from compare import frame_of
from weir.plans import analytics, contacts, deliveries, groups, registry, search

SF = "/root/testdata/sf0.001"
MODULES = (registry, search, analytics, contacts, groups, deliveries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    got = frame_of(QUERIES[name](spark, SF).toPandas())
    if name not in SQL:
        assert not got.duplicated().any()
        return
    want = frame_of(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
