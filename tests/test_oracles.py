"""Every registered query of the flood library against its SQL."""

import pytest

from freshet.plans import registry
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, data, con, name):
    compare(registry.QUERIES[name](spark, data), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and (df.count() > 0 or name == "earliest_arrival")  # the smallest input has no dry mainland


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
