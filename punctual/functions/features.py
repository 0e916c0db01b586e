"""Scalar feature expressions (calendar, clock, delay category, duration).

All functions return ``Column`` expressions or add columns with one
``select`` so the whole feature build stays a single codegen'd projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.schema import DELAY_THRESHOLD_MIN, SERVING_TIME_OF_DAY, TIME_OF_DAY, TIME_OF_DAY_EDGES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def no_nan(col) -> Column:
    """NaN -> null.  In Spark ``NaN > 15`` is true and ``avg`` propagates NaN,
    while the reference treats a missing number as not late and skips it."""
    c = _c(col)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


# --- F1/F2 lenient date parse -------------------------------------------------
def lenient_date(col, fmt: str | None = None) -> Column:
    """String/timestamp -> date; unparseable values become null (never raise)."""
    c = _c(col)
    if fmt:
        return F.to_date(F.try_to_timestamp(c.cast("string"), F.lit(fmt)))
    return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("date"),
                      F.try_to_timestamp(c.cast("string"), F.lit("M/d/yyyy")).cast("date"))


# --- F3-F8 calendar parts -----------------------------------------------------
def month_name(col) -> Column:
    return F.date_format(_c(col), "MMMM")


def weekday_name(col) -> Column:
    return F.date_format(_c(col), "EEEE")


def weekday_num(col) -> Column:
    """0 = Monday ... 6 = Sunday (``dayofweek`` would be 1 = Sunday)."""
    return F.weekday(_c(col))


def short_weekday(col) -> Column:
    return F.substring(weekday_name(col), 1, 3)


# --- F9-F12, F21 clock / distance group ---------------------------------------------
def hour_of(hhmm) -> Column:
    """HHMM integer -> hour (floor division by 100); null stays null."""
    return F.floor(_c(hhmm) / 100).cast("int")


def time_of_day(hour) -> Column:
    """Right-closed bins [0,6], (6,12], (12,18], (18,24]; anything else null."""
    h = _c(hour)
    e = TIME_OF_DAY_EDGES
    expr = F.when((h >= e[0]) & (h <= e[1]), TIME_OF_DAY[0])
    for i in range(1, len(TIME_OF_DAY)):
        expr = expr.when((h > e[i]) & (h <= e[i + 1]), TIME_OF_DAY[i])
    return expr


def serving_time_of_day(hour) -> Column:
    """Left-closed bins used when scoring a request: [0,6) [6,12) [12,18) else Evening."""
    h = _c(hour)
    return (F.when(h < 6, SERVING_TIME_OF_DAY[0]).when(h < 12, SERVING_TIME_OF_DAY[1])
             .when(h < 18, SERVING_TIME_OF_DAY[2]).otherwise(SERVING_TIME_OF_DAY[3]))


def dep_time_block(hour) -> Column:
    """``HH00-HH59`` departure block label."""
    h = _c(hour)
    return F.format_string("%02d00-%02d59", h, h)


def distance_group(distance) -> Column:
    """250-mile steps, 1..11, left-closed, capped at 11."""
    return F.least(F.floor(_c(distance) / 250) + 1, F.lit(11)).cast("int")


# --- F13/F14 delay category and flag ---------------------------------------------
def delay_category(col) -> Column:
    d = no_nan(col)
    return (F.when(d.isNull(), "Unknown").when(d < 0, "Early").when(d == 0, "On Time")
             .when(d <= 15, "Small Delay").when(d <= 60, "Moderate Delay")
             .when(d <= 180, "Large Delay").otherwise("Very Large Delay"))


def is_delayed(col, threshold: float = DELAY_THRESHOLD_MIN) -> Column:
    """1 when minutes > threshold; missing counts as 0 (not late)."""
    return F.coalesce((no_nan(col) > threshold).cast("int"), F.lit(0))


# --- F16/F17 durations ---------------------------------------------------------------
def minutes_of_day(hhmm) -> Column:
    c = _c(hhmm)
    return F.floor(c / 100) * 60 + c % 100


def duration_minutes(start_hhmm, end_hhmm) -> Column:
    """End minus start in minutes, +1440 when the trip crosses midnight."""
    d = minutes_of_day(end_hhmm) - minutes_of_day(start_hhmm)
    return F.when(d < 0, d + 1440).otherwise(d).cast("int")


# --- table-level builders ------------------------------------------------------------
def add_temporal(df: DataFrame, date_col: str = "FlightDate") -> DataFrame:
    """F1-F6 (+ F7): parse date, drop invalid dates, add calendar columns."""
    dt = df.schema[date_col].dataType.typeName()
    if dt != "date":
        df = df.withColumn(date_col, lenient_date(date_col) if dt == "string" else F.col(date_col).cast("date"))
    df = df.filter(F.col(date_col).isNotNull())
    d = F.col(date_col)
    cols = {
        "Year": F.year(d) if "Year" not in df.columns else F.col("Year"),
        "Month": F.month(d),
        "MonthName": month_name(d),
        "DayOfWeek": weekday_num(d),
        "DayOfWeekName": weekday_name(d),
        "WeekOfYear": F.weekofyear(d),
    }
    return df.withColumns(cols)


def add_clock(df: DataFrame) -> DataFrame:
    """departure hour and right-closed time of day (null if no CRSDepTime)."""
    hour = hour_of("CRSDepTime") if "CRSDepTime" in df.columns else F.lit(None).cast("int")
    df = df.withColumn("DepHour", hour)
    return df.withColumn("DepTimeOfDay", time_of_day("DepHour"))


def add_delay_flags(df: DataFrame) -> DataFrame:
    """Categories and >15-minute flags for arrival and departure."""
    out = {}
    for side in ("Arr", "Dep"):
        src = f"{side}DelayMinutes"
        if src in df.columns:
            out[f"{side}DelayCategory"] = delay_category(src)
            out[f"Is{side}Delayed"] = is_delayed(src)
        else:
            out[f"{side}DelayCategory"] = F.lit("Unknown")
            out[f"Is{side}Delayed"] = F.lit(None).cast("int")
    return df.withColumns(out)


def prepare_features(df: DataFrame) -> DataFrame:
    """The feature table every analysis query starts from."""
    return add_delay_flags(add_clock(add_temporal(df)))


# --- F26 / F31 / F33 presentation helpers -------------------------------------------
def format_metric(col, kind: str = "percentage", decimals: int = 1) -> Column:
    """number -> display text, rounded half-even as the exact binary value says; null or NaN -> 'N/A'."""
    zeros = "0" + ("." + "0" * decimals if decimals else "")
    pattern, unit = {"percentage": (zeros, "%"), "minutes": (zeros, " min"), "count": ("#,##0", ""),
                     "plain": (zeros, "")}[kind]
    v = _c(col).cast("double")
    text = F.call_function("format_number", v, F.lit(pattern))
    return F.when(v.isNull() | F.isnan(v), "N/A").otherwise(F.concat(text, F.lit(unit)))


def risk_level(probability) -> Column:
    """delay risk band from a probability: < 20 % Low, < 40 % Medium, else High."""
    pct = _c(probability) * 100
    return F.when(pct < 20, "Low").when(pct < 40, "Medium").otherwise("High")


def outcome_label(flag) -> Column:
    """1 -> 'Delayed', 0 -> 'On-Time'."""
    return F.when(_c(flag) == 1, "Delayed").otherwise("On-Time")
