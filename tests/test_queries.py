"""Registered queries next to their SQL twins, all of them."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

ALL = list(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", ALL)
def test_query(spark, con, sf, name):
    ok, rows, note = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(ALL)
