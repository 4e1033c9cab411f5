import pytest

from sedgewire import catalog
from sedgewire.oracle import difference, duck

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLE_SQL[name]) == ""
