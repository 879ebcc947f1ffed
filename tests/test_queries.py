import pytest
from compare import check, connect

from lectern.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, sf_dir, name):
    check(spark, con, sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    assert frame.columns
    frame.write.format("noop").mode("overwrite").save()
