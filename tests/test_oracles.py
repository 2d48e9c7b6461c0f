"""Every registered query against its DuckDB text."""

import pytest

from compare import ORACLES, QUERIES, compare, connect

FOLDER = "/root/testdata/sf0.001"

# Results that are rightly empty at this scale.
MAY_BE_EMPTY = {"e06_equal_ordered", "e07_equal_bag"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", QUERIES)
def test_same_rows(spark, duck, key):
    problem = compare(spark, duck, FOLDER, key)
    assert problem is None or (problem == "both empty" and key in MAY_BE_EMPTY)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
