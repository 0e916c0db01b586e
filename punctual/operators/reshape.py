"""Pivots, rankings, tagged unions and dimension lookups.

Top-k uses ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps its own k best rows and only
those are merged, so no full sort or single-partition shuffle of the input
happens.  Every ranking adds the group key as a final tie-break so results
are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions.features import short_weekday
from punctual.operators import aggregates as A
from punctual.schema import DELAY_CATEGORIES

WEEKDAY_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows by ``order`` (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def tagged_union(parts: dict[str, DataFrame], tag: str = "ranking") -> DataFrame:
    """Union of DataFrames with a tag column; duplicates are kept."""
    out = None
    for name, part in parts.items():
        p = part.select(F.lit(name).alias(tag), "*")
        out = p if out is None else out.unionByName(p)
    return out


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Top k with a 1-based rank column (rank computed on <= k rows only)."""
    from pyspark.sql import Window
    top = top_k(df, order, k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# ---------------------------------------------------------------------------
# V1 / V2 pivots
# ---------------------------------------------------------------------------
def hour_weekday_pivot(feat: DataFrame, metric: str = "avg_arr_delay") -> DataFrame:
    """V1: weekday x departure-hour matrix of ``avg_arr_delay`` or ``arr_delay_rate``.

    The 25 hour values (2400 is hour 24) are fixed, so ``pivot`` needs no extra job to discover
    them and the whole matrix is one aggregation.
    """
    src = {"avg_arr_delay": F.avg("ArrDelayMinutes"),
           "arr_delay_rate": F.avg(F.col("IsArrDelayed").cast("double"))}[metric]
    f = feat.filter(F.col("DayOfWeekName").isNotNull() & F.col("DepHour").isNotNull())
    return f.groupBy("DayOfWeekName").pivot("DepHour", list(range(25))).agg(src)


def calendar_pivot(daily: DataFrame, value: str = "avg_arr_delay") -> DataFrame:
    """V2: ISO week x short weekday, mean of the daily values (years merged)."""
    d = daily.withColumn("dow_short", short_weekday("FlightDate"))
    return d.groupBy("WeekOfYear").pivot("dow_short", WEEKDAY_SHORT).agg(F.avg(value)).orderBy("WeekOfYear")


# ---------------------------------------------------------------------------
# O4 / O5 rankings over aggregates
# ---------------------------------------------------------------------------
def airline_rankings(airline_agg: DataFrame, k: int = 15) -> DataFrame:
    """Explore view: top-k airlines by average delay and by cancel rate."""
    cols = ["Airline", "avg_arr_delay", "cancel_rate", "total_flights"]
    return tagged_union({
        m: ranked(airline_agg.select(*cols), [F.col(m).desc_nulls_last(), F.col("Airline")], k)
        for m in ("avg_arr_delay", "cancel_rate")})


def route_rankings(route_agg: DataFrame, k: int = 20,
                   sort_cols=("avg_arr_delay", "arr_delay_rate", "cancel_rate")) -> DataFrame:
    """Top-k routes for each selectable sort column (one tagged result)."""
    cols = ["Origin", "Dest", "Route", "avg_arr_delay", "arr_delay_rate", "cancel_rate", "total_flights"]
    return tagged_union({
        m: ranked(route_agg.select(*cols), [F.col(m).desc_nulls_last(), F.col("Origin"), F.col("Dest")], k)
        for m in sort_cols})


def airline_best_worst(airline_agg: DataFrame, k: int = 10) -> DataFrame:
    """Insights view: worst k / best k by average delay, and the k' busiest."""
    cols = ["Airline", "avg_arr_delay", "arr_delay_rate", "cancel_rate", "total_flights"]
    a = airline_agg.select(*cols)
    return tagged_union({
        "worst_avg_delay": ranked(a, [F.col("avg_arr_delay").desc_nulls_last(), F.col("Airline")], k),
        "best_avg_delay": ranked(a, [F.col("avg_arr_delay").asc_nulls_last(), F.col("Airline")], k),
        "busiest": ranked(a, [F.col("total_flights").desc(), F.col("Airline")], 15),
    })


def month_best_worst(monthly: DataFrame) -> DataFrame:
    """Seasonal view: 5 worst / 5 best months by delay, 3 worst by cancellations."""
    cols = ["MonthName", "avg_delay", "delay_rate_pct", "cancel_rate_pct"]
    m = monthly.select(*cols)
    return tagged_union({
        "worst_delay": ranked(m, [F.col("avg_delay").desc_nulls_last(), F.col("MonthName")], 5),
        "best_delay": ranked(m, [F.col("avg_delay").asc_nulls_last(), F.col("MonthName")], 5),
        "worst_cancel": ranked(m, [F.col("cancel_rate_pct").desc_nulls_last(), F.col("MonthName")], 3),
    })


def monthly_page_stats(feat: DataFrame) -> DataFrame:
    """Per month name: avg delay, delay rate %, cancel rate %, flights."""
    return A.group(feat, ["MonthName"], {
        "avg_delay": A.mean("ArrDelayMinutes"), "delay_rate_pct": A.rate("IsArrDelayed") * 100,
        "cancel_rate_pct": A.rate("Cancelled") * 100, "flights": A.size()})


def problem_routes(route_agg: DataFrame, q: float = 0.75, k: int = 10) -> DataFrame:
    """P-15: busy *and* late routes (both above their q-quantile), busiest k."""
    from punctual.operators.filters import above_quantiles
    hot = above_quantiles(route_agg, ["total_flights", "arr_delay_rate"], q)
    return ranked(hot.select("Origin", "Dest", "Route", "total_flights", "arr_delay_rate", "avg_arr_delay"),
                  [F.col("total_flights").desc(), F.col("Origin"), F.col("Dest")], k)


def best_worst_categories(feat: DataFrame, min_flights: int, k: int = 5) -> DataFrame:
    """J4/U3/P-14: delay-category mix of the k worst and k best airlines by delay rate.

    The reference ranks airlines, then re-filters the flights to those airlines
    (semi join) and aggregates again.  Here the per-airline rate, size and all
    category shares come from *one* aggregation; the ranking then runs on that
    small result, so the flights are scanned and shuffled once.  An airline can
    appear on both sides when there are fewer than 2k airlines.
    """
    n = A.size()
    m = {"arr_delay_rate": A.rate("IsArrDelayed"), "avg_arr_delay": A.mean("ArrDelayMinutes"),
         "total_flights": n}
    for c in DELAY_CATEGORIES:
        m[c] = F.count_if(F.col("ArrDelayCategory") == c) * 100.0 / n
    per_airline = A.group(feat, ["Airline"], m).filter(F.col("total_flights") >= min_flights)
    return tagged_union({
        "worst": ranked(per_airline, [F.col("arr_delay_rate").desc_nulls_last(), F.col("Airline")], k),
        "best": ranked(per_airline, [F.col("arr_delay_rate").asc_nulls_last(), F.col("Airline")], k),
    }, tag="side")
