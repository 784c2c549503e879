"""Every query over the smallest tables: against its SQL, or that it runs."""

import pytest

from cladewise.plans import catalog

from .oracle import SF, compare, database

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
SLOW = {"C07_training_history", "C08_predictions"}  # their parts have tests of their own


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - SLOW))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns and frame.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert e.oracle_sql().keys() <= e.queries().keys() and catalog.queries().keys() <= e.queries().keys()
