"""Every registered query against its SQL."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry

# The corpus operators have tests of their own.
NAMES = [name for c in entry._CATALOGS for name in c.queries]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert differences(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
