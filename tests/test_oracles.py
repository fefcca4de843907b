"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_twin(spark, con, key):
    why = compare(con, spark, SF, entry.queries()[key], ORACLES[key])
    spark.catalog.clearCache()
    assert why == "", why


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
