"""Every registered query with SQL against its counterpart, at the smallest scale.

The training-data queries have tests of their own in ``tests/llm``. A query that trains on matches with all features
present runs at the next scale, since the smallest tables have none.
"""

import os

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from checks import load

SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COMPLETE_ROWS = {"m4_poisson_stationary_point"}
NAMES = sorted(n for n in load().ORACLES if n not in COMPLETE_ROWS)
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare.compare(spark, con, SMALL, name, queries()[name], oracle_sql()[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(COMPLETE_ROWS))
def test_query_equals_sql_at_the_next_scale(spark, name):
    ok, note = compare.compare(spark, compare.connect(NEXT), NEXT, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_every_sql_has_a_query_and_the_entry_runs(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
