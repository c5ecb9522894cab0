"""Every registered query that has an SQL form agrees with it."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, small, name):
    assert check(spark, con, small, name) is None


def test_every_sql_form_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).count() == 7
