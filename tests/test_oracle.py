"""Every query with SQL returns exactly the rows DuckDB computes on the same tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point
from groupaudit.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, sf, duck, name):
    q = QUERIES[name]
    assert compare(q.fn(spark, sf).toArrow(), duck.sql(q.sql).to_arrow_table()) == []


def test_every_query_has_sql():
    assert [n for n, q in QUERIES.items() if q.sql is None] == []


def test_driver_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    row = entry_point.entry(spark).first()
    assert row["n_sessions"] == row["n_pathological"] + row["n_healthy"]
