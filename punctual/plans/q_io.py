"""Registered source / sink / streaming queries (S1-S5, streaming daily summary)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from punctual.operators import aggregates as A
from punctual.plans.catalog import register
from punctual.plans.sql import q, r6
from punctual.session import fresh_path
from punctual.sources import files
from punctual.sources.flights import flights
from punctual.streaming.daily import read_daily, start_daily_stream


def _yearly_csv(spark, sf_dir) -> str:
    """Write the flights as one CSV folder per year, named like the source files."""
    root = fresh_path(spark, "csv_inputs")
    f = flights(spark, sf_dir)
    years = [r[0] for r in f.select("Year").distinct().orderBy("Year").collect()]   # a handful of years
    for y in years:
        path = os.path.join(root, f"{files.SOURCE_PREFIX}_Flights_{y}.csv")
        f.filter(F.col("Year") == y).drop("Year").write.mode("overwrite").option("header", True).csv(path)
    return root


@register("load_csv", q("""
SELECT CAST(year(FlightDate) AS INT) AS Year, count(*) AS rows, min(FlightDate) AS first_date,
       max(FlightDate) AS last_date, CAST(sum(ArrDelayMinutes) AS DOUBLE) AS arr_delay_sum,
       CAST(count_if(Cancelled = 1) AS BIGINT) AS cancelled
FROM flights GROUP BY 1"""))
def load_csv(spark, sf_dir):
    """Discover the yearly CSV inputs, read them with the fixed schema."""
    root = _yearly_csv(spark, sf_dir)
    paths = files.existing(spark, files.discover_inputs(spark, root) + [os.path.join(root, "Combined_missing.csv")])
    raw = files.read_flights_csv(spark, paths)
    year = F.regexp_extract("source_file", r"_(\d{4})\.csv", 1).cast("int")
    return raw.groupBy(year.alias("Year")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("FlightDate").alias("first_date"),
        F.max("FlightDate").alias("last_date"), F.sum("ArrDelayMinutes").alias("arr_delay_sum"),
        F.count_if(F.col("Cancelled")).alias("cancelled"))


@register("write_roundtrip", q(f"""
SELECT CAST(year(FlightDate) AS INT) AS Year, Airline, count(*) AS rows, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}
FROM flights WHERE Airline IS NOT NULL GROUP BY 1, 2"""))
def write_roundtrip(spark, sf_dir):
    """Write parquet partitioned by year, read back with a year filter
    (partition pruning) per year."""
    path = files.write_table(flights(spark, sf_dir), fresh_path(spark, "roundtrip_parquet"))
    back = spark.read.parquet(path)
    return A.group(back, ["Year", "Airline"], {"rows": A.size(), "avg_arr_delay": A.mean("ArrDelayMinutes")})


@register("stream_daily_delays", q(f"""
SELECT FlightDate, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('avg(DepDelayMinutes)', 'avg_dep_delay')},
       {r6('avg(IsArrDelayed)', 'arr_delay_rate')}, {r6('avg(IsDepDelayed)', 'dep_delay_rate')},
       {r6('avg(Cancelled)', 'cancel_rate')}, {r6('avg(Diverted)', 'divert_rate')}, count(*) AS total_flights
FROM features GROUP BY FlightDate"""))
def stream_daily_delays(spark, sf_dir):
    """Daily summary maintained by a streaming query over yearly parquet files."""
    src = fresh_path(spark, "stream_src")
    f = flights(spark, sf_dir)
    f.hint("rebalance", "Year").write.partitionBy("Year").parquet(src)
    schema = spark.read.parquet(src).schema
    sink = fresh_path(spark, "stream_sink")
    # a new source has a new stream: source, sink and state belong together
    qy = start_daily_stream(spark, src, schema, sink, fresh_path(spark, "stream_ckpt"), available_now=True)
    qy.awaitTermination()
    return read_daily(spark, sink)
