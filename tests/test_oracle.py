"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark, tiny):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, con, name):
    assert differences(spark, QUERIES[name], SQL[name], tiny, con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0
