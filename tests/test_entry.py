"""Registered queries against their SQL, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from vexel.plans import queries as plans

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, AT)
    want = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, AT).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 250
    assert set(e.oracle_sql()) <= set(e.queries())
