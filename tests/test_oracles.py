"""Every registered query against its DuckDB oracle on the smallest test set."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    ok, note = compare(spark, con, entry.queries()[key], ORACLES[key], SF)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
