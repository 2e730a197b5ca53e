"""The operators that SQL can express, and the shape of all registered queries."""

import pytest

from ledgerloom.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(compare, name):
    compare(QUERIES[name], SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
