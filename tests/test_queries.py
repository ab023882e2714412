"""Every query against its SQL on the same tables; queries without SQL give rows of a stable schema."""

import pytest
from conftest import SF, same

from barwright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
