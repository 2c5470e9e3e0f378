"""Registered queries of scalar, type, lookup and engine operators, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import derived, engine_queries, standins

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in standins.QUERIES.items() if f.__module__ == derived.__name__] + ["closure_returns", "class_answers", "descent_steps"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_engine_queries_are_registered():
    assert {n for n, f in standins.QUERIES.items() if f.__module__ == engine_queries.__name__} == {"recovered_shapes", "callable_sites", "closure_returns", "class_answers"}


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, db, name):
    df = standins.QUERIES[name](spark, SF)
    cur = db.execute(standins.SQL[name])
    columns = [d[0] for d in cur.description]
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert sorted(columns) == sorted(df.columns) and want
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)
