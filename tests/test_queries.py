"""Every registered query with a SQL twin gives the same rows on DuckDB; the contract holds together."""

import pytest

import __spark_entry__ as contract
from checks import connection, difference

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(contract.queries()[name](spark, SF), duck, ORACLES[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 1


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", ["scatter_sample", "column_stats_approximate", "permutation_threshold", "selected_features", "model_ridge_regression"])
def test_rows_only(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
