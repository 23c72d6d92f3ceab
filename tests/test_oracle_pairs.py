"""Every query with SQL gives DuckDB's rows; those without run and keep a stable schema."""

import pytest
from conftest import rows_of

from lodestar.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, duck):
    df = plans.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in plans.ORACLES:
        assert got and df.columns
        return
    want = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
