"""The driver's contract, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["snap_no", "subject", "doc_id", "change_kind"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(n for m in entry.MODULES if ".llm." not in m.__name__ for n in m.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from compare import canon

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{t}')")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())
