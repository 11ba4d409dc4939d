import pytest

import __spark_entry__ as entry
from phrasewright.plans import registry

from .holding import DATA, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name], con)


def test_every_query_has_sql_and_the_entry_lists_them():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
