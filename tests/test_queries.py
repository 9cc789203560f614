import pytest
from compare import database, difference

from __spark_entry__ import entry, oracle_sql, queries
from workloads.oracle import ORACLE
from workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert difference(queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
