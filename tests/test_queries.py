"""Every query against its SQL on the smallest tables."""

import pytest
from oracles import assert_same, database

from keyfold.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name])
    spark.catalog.clearCache()


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
