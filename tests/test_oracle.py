"""Every query with SQL gives what the SQL gives; every other query gives rows of a stable schema."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from kestrelgraph.plans import activity, answers, dialogue, graph, insight, pipeline, questions, reading, statements, store

CORE = [n for suite in (pipeline, store, graph, activity, answers, statements, questions, insight, dialogue, reading) for n in suite.QUERIES]


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()[:19]
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert registry.entry(spark).count() > 0
