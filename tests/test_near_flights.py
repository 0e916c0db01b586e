"""Rows beyond a hash bound are dropped before the joins; the draws stay those over all flights."""

import pytest
from pyspark.sql import functions as F

from punctual.operators import sampling as S
from punctual.plans import pipeline as PL
from punctual.schema import TARGET
from punctual.sources import flights as FL

K = 60


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    tables = {
        "lineitem": spark.range(6000).selectExpr(
            "id div 4 as l_orderkey", "id % 50 as l_partkey", "id % 20 as l_suppkey", "cast(id % 4 as int) as l_linenumber",
            "cast(id % 30 as double) as l_quantity", "cast(date_add(date'1995-01-01', cast(id % 900 as int)) as timestamp) as l_shipdate"),
        # every sixth order is missing, so there are fewer flights than line items
        "orders": spark.range(1500).where("id % 6 > 0").selectExpr("id as o_orderkey", "id % 40 as o_custkey"),
        "customer": spark.range(40).selectExpr("id as c_custkey", "cast(id % 5 as int) as c_nationkey"),
        "supplier": spark.range(20).selectExpr("id as s_suppkey", "cast(id % 5 as int) as s_nationkey"),
        "part": spark.range(50).selectExpr("id as p_partkey", "concat('Brand#', id % 7) as p_brand"),
        "nation": spark.range(5).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name")}
    for name, df in tables.items():
        df.write.parquet(f"{d}/{name}.parquet")
    return d


def keys(df, *more):
    return sorted(tuple(r) for r in df.select(*FL.ROW_KEY, *more).collect())


def test_sample_is_the_one_over_all_flights(spark, star, monkeypatch):
    f = FL.flights_view(spark, star).withColumn("Year", F.year("FlightDate"))
    want = keys(S.sample_per_group(f, "Year", K, "FlightKey", FL.ROW_KEY, seed=PL.SEED), "Year")
    assert len(want) == 3 * K
    for times in (1, 100):       # right numbers, and numbers so high that the first bounds are too low
        monkeypatch.setattr(PL, "_CACHE", {})
        monkeypatch.setattr(PL, "line_items_by_year", lambda *a: {y: n * times for y, n in FL.line_items_by_year(*a).items()})
        got = PL.sampled_flights(spark, star, K)
        assert keys(got, "Year") == want and sorted(got.columns) == sorted(f.columns)
        near, _ = PL.near_flights(spark, star, K)
        assert near.filter("__sample").count() < f.count()
    assert FL.fingerprint(spark, star) not in {k[1] for k in FL._MATERIALISED}


def test_marked_line_items_are_dropped_before_the_joins(spark, star):
    low = {"low": S.hash_hex("FlightKey", 1) < S.hash_bound(0.1)}
    rows = FL.flights_view(spark, star, low)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "md5" in line and "Filter" in line]
    assert at and max(i for i, line in enumerate(plan) if "Join" in line and i < at[0]) < at[0]
    every = FL.flights_view(spark, star)
    assert keys(rows.filter("low")) == keys(every.filter(S.hash_hex("FlightKey", 1) < S.hash_bound(0.1)))


@pytest.mark.parametrize("factor", [3, 0.05, 1000])
def test_extra_rows_are_those_of_the_whole_pool(spark, star, monkeypatch, factor):
    """Near rows suffice, are too few, or are all."""
    real = PL.near_flights
    monkeypatch.setattr(PL, "_CACHE", {})
    monkeypatch.setattr(PL, "POOL_FACTOR", factor)
    monkeypatch.setattr(PL, "near_flights", lambda spark, d, k=K: real(spark, d, K))
    got = PL.balanced_train(spark, star)
    s = PL.split(spark, star)
    train = s.filter("split = 'train'").drop("split").withColumn("source", F.lit("base"))
    pool = PL.model_table(spark, star, sampled=False).withColumn("source", F.lit("extra"))
    want = S.balance_classes(train, pool, TARGET, "FlightKey", FL.ROW_KEY, exclude=s.filter("split = 'test'"),
                             seed=PL.EXTRA_SEED)
    assert keys(got, TARGET, "source") == keys(want, TARGET, "source")
    assert real(spark, star, K)[1] == (factor == 1000) and got.filter("source = 'extra'").count() > 0
