import pytest

from oracle import assert_same, connection
from tarnql import queries, synthetic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, con, name):
    assert_same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(synthetic.queries()))
def test_synthetic_query_against_sql(spark, con, name):
    assert_same(synthetic.queries()[name](spark, SF), con, synthetic.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["n_name", "revenue"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries.tpch_q6(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_orderkey" not in plan
