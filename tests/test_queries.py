"""Every query with SQL against DuckDB; the others yield rows on whole tables."""

import pytest
from harness import assert_same, database

from pairwave.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf, con, name):
    assert_same(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
