"""Every relational query against its SQL on the smallest tables."""

import pytest

from riskloom.plans import catalogue
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, small, oracle, name):
    assert_same(catalogue.QUERIES[name](spark, small), oracle, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
