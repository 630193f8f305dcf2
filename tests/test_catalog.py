import pytest
from oracle import duck, same
from runledger.plans import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    assert same(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER, con) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.status for r in e.entry(spark).collect()} <= {"pending", "running", "success", "failed", "paused"}
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
