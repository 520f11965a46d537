"""Every registered query against its SQL oracle."""

import os

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import difference, duckdb_over
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duckdb_over(SMALL)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) <= set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_oracle(spark, connection, name):
    assert difference(entry.queries()[name](spark, SMALL), connection, ORACLES[name]) is None


LARGE_PATHS = [
    name for name in registry.QUERIES
    if name.startswith(("jon_", "win_", "cln_price_", "cln_weight_", "enr_orders_"))
]


@pytest.mark.usefixtures("always_salt")
@pytest.mark.parametrize("name", LARGE_PATHS)
def test_paths_for_large_data_equal_the_oracle(spark, connection, name):
    """The plans that real sizes get: shuffled, salted joins and narrowed quantiles."""
    df = registry.QUERIES[name](spark, SMALL)
    assert difference(df, connection, ORACLES[name]) is None


def test_comparison_sees_a_difference(spark, connection):
    query = registry.QUERIES["exp_orders_by_status"]
    wrong = ORACLES["exp_orders_by_status"].replace("count(order_id)", "count(order_id) + 1")
    assert "rows differ" in difference(query(spark, SMALL), connection, wrong)


def test_entry(spark):
    report = entry.entry(spark)
    assert report.columns[0] == "purchase_month_name"
    assert report.count() > 0
