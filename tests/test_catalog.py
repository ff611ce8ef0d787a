"""Every registered query against its DuckDB oracle on the smallest tables, plus the
driver contract."""

import pytest

import __spark_entry__ as entry_module
from rostra.plans import catalog
from rostra.plans.verify import compare, duckdb_connection

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SMALL, con)
    assert r["status"] == "match", r


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(NAMES)


def test_entry_contract(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["year", "label", "n"]
    assert df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
