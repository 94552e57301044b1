"""Every query of the audit engine against its oracle SQL, on the smallest tables."""

import pytest
from compare import oracle_rows, rows_of

from veritrace.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    columns, rows = rows_of(registry.QUERIES[name](spark, DATA))
    assert rows
    if name in registry.ORACLE_SQL:
        names, want = oracle_rows(registry.ORACLE_SQL[name], DATA)
        assert columns == names
        assert rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
