"""Every registered retrieval query against its SQL, or at least run, on the smallest tables."""

import compare
import pytest

from lodestone import registry


@pytest.fixture(scope="module")
def sql():
    return compare.connection()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, compare.SF)
    if name in registry.ORACLES:
        assert compare.difference(df, registry.ORACLES[name], sql) == ""
    else:
        assert df.count() > 0


def test_oracles_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
