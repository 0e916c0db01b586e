import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from punctual.operators import routes as R
from punctual.session import fresh_path

SCHEMA = "FlightDate date, Origin string, Dest string, Distance double"


def flights(spark, rows):
    return spark.createDataFrame(rows, "day string, Origin string, Dest string, Distance double").select(
        F.to_date("day").alias("FlightDate"), "Origin", "Dest", "Distance").repartition(4)


def some(n, hot):
    """A hot route with many distances, a few others, rows without route or distance."""
    rows = [(f"20{18 + i % 3}-01-0{1 + i % 9}", "A", "B", float(i * 37 % 500)) for i in range(hot)]
    rows += [("2018-05-05", f"O{i % 7}", f"D{i % 3}", float(100 + i % 4)) for i in range(n)]
    return rows + [("2019-01-01", None, "B", 3.0), ("2019-01-01", "A", "B", None), ("2019-01-01", "X", "Y", None)]


def medians(rows):
    by = {}
    for _, o, d, x in rows:
        if o and d and x is not None:
            by.setdefault((o, d), []).append(x)
    return {k: statistics.median(v) for k, v in by.items()}


def got(df):
    return {(r.Origin, r.Dest): r.route_distance for r in df.collect()}


def test_batches_merge_and_replace_themselves(spark):
    path, a, b = fresh_path(spark, "routes"), some(60, 501), some(31, 1000)
    R.add_batch(flights(spark, a), path, "1")
    assert got(R.route_medians(R.read_counts(spark, path))) == medians(a)
    R.add_batch(flights(spark, a[:5]), path, "2")
    R.add_batch(flights(spark, b), path, "2")                    # a retried batch counts once
    assert got(R.route_medians(R.read_counts(spark, path))) == medians(a + b)
    assert got(R.route_medians(R.read_counts(spark, R.compact(spark, path)))) == medians(a + b)
    one = [r for r in a + b if r[0].startswith("2018")]
    assert got(R.route_medians(R.read_counts(spark, path, (2018, 2018)))) == medians(one)


def test_requests_read_counts_only(spark):
    path, a = fresh_path(spark, "routes"), some(60, 501)
    R.add_batch(flights(spark, a), path, "1")
    req = spark.createDataFrame([(1, "A", "B", None), (2, "A", "B", 7.0), (3, "no", "route", None), (4, None, "B", None),
                                 (5, "X", "Y", None)], "id int, Origin string, Dest string, Distance double")
    out = R.fill_distance(req, R.read_counts(spark, path))
    assert {r.id: r.Distance for r in out.collect()} == {1: medians(a)["A", "B"], 2: 7.0, 3: 1000.0, 4: 1000.0, 5: 1000.0}
    assert "PartitionFilters: [isnotnull(Year" in R.read_counts(spark, path, (2018, 2019))._jdf.queryExecution().executedPlan().toString()


def test_stream_feeds_the_store(spark):
    base = fresh_path(spark, "routes")
    a, b = some(20, 30), some(10, 41)
    schema = flights(spark, a).schema
    for rows in (a, b):
        flights(spark, rows).write.mode("append").parquet(f"{base}/in")
        q = R.start_route_stream(spark, f"{base}/in", schema, f"{base}/store", f"{base}/checkpoint")
        q.awaitTermination()
    assert got(R.route_medians(R.read_counts(spark, f"{base}/store"))) == medians(a + b)
