"""Golden edge rows for the scalar features (FIXTURES §4.1, §4.2)."""

import datetime as dt

from pyspark.sql import functions as F

from punctual.functions import features as fx
from punctual.functions.bins import cut
from punctual.schema import DISTANCE_EDGES_EDA, DISTANCE_EDGES_INSIGHT, DISTANCE_LABELS

ROWS = [  # FlightDate, CRSDepTime, ArrDelayMinutes
    ("2018-01-01", 0, 0.0), ("2021-01-03", 600, 15.0), ("2020-12-31", 700, 16.0), ("2019-12-30", 1200, 60.0),
    ("2018-01-01", 1300, 61.0), ("2018-01-01", 1800, 180.0), ("2018-01-01", 2359, 181.0),
    ("2018-01-01", 2400, -1.0), ("2018-01-01", 900, None), ("x", 900, 5.0), ("2018-01-01", 2500, float("nan")),
]
EXPECT = [  # DayOfWeek, ISO week, Quarter, DepHour, TimeOfDay, serving, Category, IsArrDelayed
    (0, 1, 1, 0, "Night (0-6)", "Night", "On Time", 0),
    (6, 53, 1, 6, "Night (0-6)", "Morning", "Small Delay", 0),
    (3, 53, 4, 7, "Morning (6-12)", "Morning", "Moderate Delay", 1),
    (0, 1, 4, 12, "Morning (6-12)", "Afternoon", "Moderate Delay", 1),
    (0, 1, 1, 13, "Afternoon (12-18)", "Afternoon", "Large Delay", 1),
    (0, 1, 1, 18, "Afternoon (12-18)", "Evening", "Large Delay", 1),
    (0, 1, 1, 23, "Evening (18-24)", "Evening", "Very Large Delay", 1),
    (0, 1, 1, 24, "Evening (18-24)", "Evening", "Early", 0),
    (0, 1, 1, 9, "Morning (6-12)", "Morning", "Unknown", 0),
    (0, 1, 1, 25, None, "Evening", "Unknown", 0),
]


def test_feature_golden_rows(spark):
    df = spark.createDataFrame(ROWS, "FlightDate string, CRSDepTime int, ArrDelayMinutes double")
    out = fx.prepare_features(df).withColumns({
        "Quarter": F.quarter("FlightDate"), "Serving": fx.serving_time_of_day("DepHour")})
    got = [(r.DayOfWeek, r.WeekOfYear, r.Quarter, r.DepHour, r.DepTimeOfDay, r.Serving, r.ArrDelayCategory,
            r.IsArrDelayed) for r in out.collect()]
    assert got == EXPECT  # row 10 ('x') dropped, order kept


def test_names_and_blocks(spark):
    df = spark.createDataFrame([(dt.date(2018, 1, 1), 7)], "d date, h int")
    r = df.select(fx.month_name("d").alias("m"), fx.weekday_name("d").alias("w"), fx.short_weekday("d").alias("s"),
                  fx.dep_time_block("h").alias("b")).first()
    assert (r.m, r.w, r.s, r.b) == ("January", "Monday", "Mon", "0700-0759")


def test_distance_bins_and_groups(spark):
    vals = [0, 249, 250, 500, 501, 2499, 2500, 3000, 3001, 10000, 10001]
    df = spark.createDataFrame([(float(v),) for v in vals], "d double")
    out = df.select(cut("d", DISTANCE_EDGES_EDA, DISTANCE_LABELS).alias("a"),
                    cut("d", DISTANCE_EDGES_INSIGHT, DISTANCE_LABELS).alias("b"),
                    fx.distance_group("d").alias("g")).collect()
    assert [r.a for r in out] == [None, "<500", "<500", "<500", "500-1000", "2000-3000", "2000-3000",
                                  "2000-3000", ">3000", ">3000", ">3000"]
    assert [r.b for r in out] == [None, "<500", "<500", "<500", "500-1000", "2000-3000", "2000-3000",
                                  "2000-3000", ">3000", ">3000", None]
    assert [r.g for r in out] == [1, 1, 2, 3, 3, 10, 11, 11, 11, 11, 11]


def test_durations(spark):
    df = spark.createDataFrame([(2330, 115), (900, 900), (None, 900)], "a int, b int")
    assert [r[0] for r in df.select(fx.duration_minutes("a", "b")).collect()] == [105, 0, None]


def test_missing_delay_column_fallback(spark):
    df = spark.createDataFrame([("2018-01-01", 900)], "FlightDate string, CRSDepTime int")
    r = fx.prepare_features(df).first()
    assert r.ArrDelayCategory == "Unknown" and r.IsArrDelayed is None


def test_hour_24_has_a_column(spark):
    from punctual.operators.reshape import hour_weekday_pivot
    df = spark.createDataFrame([("Monday", 24, 7.0, 1), ("Monday", 0, 3.0, 0)],
                               "DayOfWeekName string, DepHour int, ArrDelayMinutes double, IsArrDelayed int")
    row = hour_weekday_pivot(df).first()
    assert row["24"] == 7.0 and row["0"] == 3.0


def test_format_metric_rounds_the_exact_value(spark):
    from punctual.functions.features import format_metric
    values = [21.45, 2.675, 0.125, 0.25, 0.35, 1234.5, None, float("nan"), -0.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(format_metric("v", "percentage", 1)).collect()]
    assert got[:6] == [f"{v:.1f}%" for v in values[:6]] and got[6:8] == ["N/A", "N/A"]
    assert df.select(format_metric("v", "count")).collect()[5][0] in ("1,234", "1,235")
