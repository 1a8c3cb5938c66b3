"""Every query with checking SQL against DuckDB; the others must give rows."""

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, small, name):
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    df = entry.entry(spark)
    assert "invoice_number" in df.columns and df.count() > 0
