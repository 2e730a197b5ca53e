"""Every query of the ledger that has SQL gives that SQL's rows; the others run."""

import pytest

from ledgerloom.jobs import catalog
from tests.conftest import SMALL

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(compare, name):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
