"""Every registered query against its SQL at the smallest scale."""

import datetime
import os

import pytest

import __spark_entry__ as entry_module

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    return 0.0 if isinstance(v, float) and v == 0 else v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want
