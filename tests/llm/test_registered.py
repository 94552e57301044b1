"""Registered queries against their oracle SQL, and on every column's nulls."""

import pytest
from compare import oracle_rows, rows_of

from veritrace.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    columns, rows = rows_of(queries.QUERIES[name](spark, DATA))
    names, want = oracle_rows(queries.ORACLE_SQL[name], DATA)
    assert columns == names
    assert rows == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
