"""Every registered query runs at the smallest scale and equals its SQL."""

import pytest

from quotemill.plans import registry
from tests.conftest import SF
from tests.oracle import connection, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).schema is not None
    QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["total_volume"] >= rows[-1]["total_volume"]
    assert set(SQL) <= set(__spark_entry__.queries())
