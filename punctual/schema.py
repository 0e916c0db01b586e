"""Fixed schemas, category labels and small dimension tables.

Dimensions (weekdays, months, delay categories, bins) are tiny and have a
size fixed by definition, so joining them with ``broadcast`` is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]
DELAY_CATEGORIES = ["Early", "On Time", "Small Delay", "Moderate Delay",
                    "Large Delay", "Very Large Delay", "Unknown"]
# Delay categories used when relating distance to lateness (no Early / Unknown).
LATE_CATEGORIES = ["On Time", "Small Delay", "Moderate Delay", "Large Delay", "Very Large Delay"]
TIME_OF_DAY = ["Night (0-6)", "Morning (6-12)", "Afternoon (12-18)", "Evening (18-24)"]
TIME_OF_DAY_EDGES = [0, 6, 12, 18, 24]
SERVING_TIME_OF_DAY = ["Night", "Morning", "Afternoon", "Evening"]
DISTANCE_LABELS = ["<500", "500-1000", "1000-1500", "1500-2000", "2000-3000", ">3000"]
DISTANCE_EDGES_EDA = [0, 500, 1000, 1500, 2000, 3000, float("inf")]
DISTANCE_EDGES_INSIGHT = [0, 500, 1000, 1500, 2000, 3000, 10000]
DURATION_LABELS = ["<1h", "1-2h", "2-3h", "3-4h", "4-6h", ">6h"]
DURATION_EDGES = [0, 60, 120, 180, 240, 360, float("inf")]
DELAY_THRESHOLD_MIN = 15
# 16 pre-departure model features, and columns that would leak the outcome.
MODEL_FEATURES = ["DayOfWeek", "DayofMonth", "DepHour", "Month", "Quarter", "Year",
                  "Distance", "DistanceGroup", "CRSDepTime", "DepTimeBlk",
                  "Airline", "Origin", "Dest", "DepTimeOfDay", "DayOfWeekName", "MonthName"]
LEAKY_COLUMNS = ["DepDelayMinutes", "DepDelay", "TaxiOut", "TaxiIn", "AirTime",
                 "ArrDelayMinutes", "ArrTime", "DepTime", "WheelsOff", "WheelsOn",
                 "ActualElapsedTime"]
# Columns kept for the modelling table, in this order, when present.
MODEL_TABLE_COLUMNS = ["Airline", "Origin", "Dest", "OriginAirportID", "DestAirportID",
                       "Distance", "DistanceGroup", "FlightDate", "Year", "Month", "MonthName",
                       "DayOfWeek", "DayOfWeekName", "DayofMonth", "Quarter", "DepHour",
                       "DepTimeOfDay", "CRSDepTime", "DepTimeBlk", "Flights"]
TARGET = "IsArrDelayed"

# ---------------------------------------------------------------------------
# Raw flight record schema (CSV input).  Types are fixed; no inference.
# ---------------------------------------------------------------------------
FLIGHTS = T.StructType([
    T.StructField("FlightDate", T.StringType()),
    T.StructField("Airline", T.StringType()),
    T.StructField("Origin", T.StringType()),
    T.StructField("Dest", T.StringType()),
    T.StructField("Cancelled", T.BooleanType()),
    T.StructField("Diverted", T.BooleanType()),
    T.StructField("CRSDepTime", T.IntegerType()),
    T.StructField("DepTime", T.DoubleType()),
    T.StructField("DepDelayMinutes", T.DoubleType()),
    T.StructField("DepDelay", T.DoubleType()),
    T.StructField("ArrTime", T.DoubleType()),
    T.StructField("ArrDelayMinutes", T.DoubleType()),
    T.StructField("AirTime", T.DoubleType()),
    T.StructField("CRSElapsedTime", T.DoubleType()),
    T.StructField("ActualElapsedTime", T.DoubleType()),
    T.StructField("Distance", T.DoubleType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("Quarter", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("DayofMonth", T.IntegerType()),
    T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("Marketing_Airline_Network", T.StringType()),
    T.StructField("Flight_Number_Marketing_Airline", T.LongType()),
    T.StructField("OriginAirportID", T.IntegerType()),
    T.StructField("DestAirportID", T.IntegerType()),
    T.StructField("DepTimeBlk", T.StringType()),
    T.StructField("TaxiOut", T.DoubleType()),
    T.StructField("TaxiIn", T.DoubleType()),
    T.StructField("CRSArrTime", T.IntegerType()),
    T.StructField("ArrTimeBlk", T.StringType()),
    T.StructField("DistanceGroup", T.IntegerType()),
    T.StructField("Flights", T.DoubleType()),
])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks as a typed null.

    Replaces the reference's ``if "X" in df.columns`` branches with one fixed
    schema so downstream operators never branch on column presence.
    """
    missing = [f for f in schema.fields if f.name not in df.columns]
    if not missing:
        return df
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def order_dim(spark: SparkSession, name: str, values: list[str], order_col: str | None = None) -> DataFrame:
    """A tiny (label, order) dimension used to restore logical order and empty groups."""
    order_col = order_col or f"{name}_order"
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)],
                                 T.StructType([T.StructField(name, T.StringType()),
                                               T.StructField(order_col, T.IntegerType())]))


def order_expr(col: str, values: list[str]) -> F.Column:
    """Position of a label in a fixed list as an expression (no join needed)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)).cast("int") - 1
