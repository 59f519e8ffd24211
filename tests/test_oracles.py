"""Every query with an SQL twin gives the same table."""

from __future__ import annotations

import pytest
from conftest import TINY
from oracle_check import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(TINY)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, TINY), duck, ORACLES[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
