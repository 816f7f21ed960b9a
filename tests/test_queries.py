"""Every registered query runs; those with an oracle give its rows."""

import pytest

from tests.compare import oracle_rows, rows_of
from tokiwa.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = rows_of(df)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
    else:
        columns, expected = oracle_rows(sql, SF)
        assert columns == sorted(df.columns)
        assert rows == expected


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
