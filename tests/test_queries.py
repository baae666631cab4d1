import pytest

from procurelake.plans import catalogue
from tests.oracle import same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, name):
    assert same(spark, catalogue.QUERIES[name], catalogue.SQL[name], DIR) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0
