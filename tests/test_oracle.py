"""Every registered query against its SQL twin, over whole tables."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tests.oracle import connect, difference
from tideline.catalogue import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, name):
    diff = difference(QUERIES[name](spark, SF), con, ORACLES[name])
    assert diff is None, diff


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_seeded_numbers_are_spread(spark):
    rows = QUERIES["seeded_int"](spark, SF).collect()
    assert sorted(r["bucket"] for r in rows) == list(range(10))
    total = sum(r["n"] for r in rows)
    assert all(0.8 * total / 10 < r["n"] < 1.2 * total / 10 for r in rows)
