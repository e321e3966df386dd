"""Every registered trace query against its SQL, on the smallest tables."""

import compare
import pytest

from tracelark.plans.catalog import QUERIES, SQL

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare.differences(spark, con, SF, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, f"{compare.DATA}/{SF}").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
