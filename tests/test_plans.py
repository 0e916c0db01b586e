"""Physical-plan checks: no cross joins anywhere, pruning and pushdown reach the scan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from punctual.plans import q_modeling
from punctual.plans.catalog import QUERIES, features

MODEL = {k for k, v in vars(q_modeling).items() if callable(v)}
RELATIONAL = sorted(k for k in QUERIES if k not in MODEL)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_year_filter_prunes_partitions_and_columns(spark):
    df = features(spark, SF_SMALL).filter(F.col("Year") == 1998).filter(F.col("Airline") == "Brand#11") \
        .groupBy("Origin").count()
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(Year" in plan and "EqualTo(Airline,Brand#11)" in plan
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln][0]
    assert "TaxiIn" not in scan and "Score" not in scan


def test_aggregations_are_partial_before_the_shuffle(spark):
    plan = _plan(E.queries()["airline_performance"](spark, SF_SMALL))
    assert "partial_percentile" in plan and "partial_avg" in plan


def test_fact_table_is_never_the_broadcast_side(spark):
    from punctual.sources.flights import flights_view
    plan = _plan(flights_view(spark, SF_SMALL))
    assert "BuildLeft" not in plan          # every join probes with the lineitem stream
    assert plan.count("BroadcastHashJoin") + plan.count("SortMergeJoin") >= 6


@pytest.mark.parametrize("name", ["explore_airlines", "explore_routes", "explore_hours", "explore_filter"])
def test_dashboard_filters_prune_years_and_reach_the_scan(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln and "Distance" in ln][0]
    assert "PartitionFilters: [isnotnull(Year" in scan and "IsNotNull(Distance)" in scan


@pytest.mark.parametrize("name", ["airline_performance", "route_distance_lookup", "problem_routes", "distance_by_category"])
def test_no_cross_joins_without_broadcasts(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(E.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_distinct_values_come_from_one_scan(spark):
    assert _plan(E.queries()["dimension_values"](spark, SF_SMALL)).count("FileScan") == 1
