"""The queries for training text against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from compare import canon
from corpusspark.llm import plans

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{t}')")
    df = plans.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.sql(plans.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_other_queries_run_over_whole_tables(spark, name):
    df = plans.QUERIES[name](spark, SMALL)
    assert df.count() >= 0 and df.columns
