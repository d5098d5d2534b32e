"""Every query with SQL gives what DuckDB gives; the others run."""

import pytest

from quillspark.plans.catalogue import ORACLES, QUERIES

from .compare import assert_same, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert_same(df, con, ORACLES[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
