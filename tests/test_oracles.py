"""Every query with an oracle equals it; every query without one returns rows."""

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("key", sorted(SQL))
def test_equals_oracle(spark, small, con, key):
    assert compare(queries()[key](spark, small), con, SQL[key]) is None


@pytest.mark.parametrize("key", sorted(set(queries()) - set(SQL)))
def test_returns_rows(spark, small, key):
    assert queries()[key](spark, small).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(queries())
