"""Every registered query against its check SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from orgloom.plans import registry
from tests.compare import compare, connect

from .conftest import SMALL

QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    assert compare(spark, con, small, name, QUERIES[name], ORACLES[name]) is None


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
