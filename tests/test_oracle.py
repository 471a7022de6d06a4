"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import database, differences

from lotwise.plans.everything import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Questions whose exact answer is no row on the smallest tables.
MAY_BE_EMPTY = {"b3_text_predicate", "b2_equality_filters", "b10_get_listing", "c7_nearby", "f5_third_page"}


@pytest.fixture(scope="module")
def connection():
    return database(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    note = differences(spark, QUERIES[name], ORACLES[name], SF, connection)
    if name in MAY_BE_EMPTY and note == "no rows":
        return
    assert note == ""
