"""Every registered query against its SQL, over the whole small tables."""

import pytest

from docloom import registry

from .conftest import SF, same_as_sql


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        same_as_sql(df, duck, sql)
    else:
        assert df.count() > 0


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(registry.queries()) <= set(e.queries())
