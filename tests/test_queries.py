"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check_sql import base_tables, compare

from __spark_entry__ import entry, oracle_sql, queries
from fleetlens.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return base_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, SQL[name]).startswith("ok")


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_the_entry_point_has_all_of_them():
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
