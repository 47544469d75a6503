"""Every registered query that has a SQL twin gives the same columns, types, rows and values."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.conftest import SMALL

TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_as_sql(spark, duck, name):
    assert differences(entry.queries()[name](spark, SMALL), duck, TWINS[name]) == []


def test_every_twin_is_registered():
    assert set(TWINS) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 8
