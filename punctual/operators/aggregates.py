"""Group-by aggregations over the feature table.

Design rules used throughout:

* One ``groupBy().agg()`` per result.  Measures that the reference computes in
  separate group-bys and merges (route cancel rate, airline cancel rate) are
  folded into the same aggregation, so each result costs exactly one shuffle.
* Every aggregate here is algebraic or bounded-state, so Spark runs a partial
  aggregation before the shuffle.  A group holding a third of all rows is
  reduced map-side to one buffer per task; skew never reaches a single reducer
  as raw rows.
* Exact medians/quantiles use ``percentile`` whose buffer is a value->count map:
  delay minutes are integers with a few thousand distinct values, so the
  buffer is bounded regardless of row count.  ``exact=False`` switches to
  ``percentile_approx`` for unbounded-cardinality measures.
* Group keys are null-filtered first (pandas drops null keys; Spark would keep
  a null group).
* Delay *rates* average the 0/1 flag over all rows (cancelled rows count as not
  late); mean/median of minutes skip nulls, exactly like the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.schema import (DELAY_CATEGORIES, LATE_CATEGORIES, MONTHS, TIME_OF_DAY, WEEKDAYS,
                             order_expr)

ARR, DEP = "ArrDelayMinutes", "DepDelayMinutes"


# ---------------------------------------------------------------------------
# reusable measures
# ---------------------------------------------------------------------------
def mean(c: str) -> Column:
    return F.avg(F.col(c))


def median(c: str, exact: bool = True) -> Column:
    return F.median(F.col(c)) if exact else F.percentile_approx(F.col(c), 0.5, 10000).cast("double")


def rate(c: str) -> Column:
    """Mean of a 0/1 (or boolean) column over all rows."""
    return F.avg(F.col(c).cast("double"))


def size() -> Column:
    return F.count(F.lit(1))


def share_if(cond: Column) -> Column:
    """Fraction of all rows meeting ``cond``; a null condition counts as false."""
    return F.count_if(F.coalesce(cond, F.lit(False))) / F.count(F.lit(1))


def _keys_not_null(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond)


def group(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """groupBy with null keys dropped and measures aliased by dict key."""
    return _keys_not_null(df, keys).groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def standard_measures(exact: bool = True) -> dict[str, Column]:
    """The measure set of the daily / airline summaries."""
    return {
        "avg_arr_delay": mean(ARR), "avg_dep_delay": mean(DEP),
        "median_arr_delay": median(ARR, exact), "median_dep_delay": median(DEP, exact),
        "arr_delay_rate": rate("IsArrDelayed"), "dep_delay_rate": rate("IsDepDelayed"),
    }


def eda_measures(exact: bool = True) -> dict[str, Column]:
    """Notebook measure set: mean/median/count of arrival, mean/median of
    departure, cancel and diversion rates."""
    return {
        "avg_arr_delay": mean(ARR), "median_arr_delay": median(ARR, exact),
        "flight_count": F.count(F.col(ARR)),
        "avg_dep_delay": mean(DEP), "median_dep_delay": median(DEP, exact),
        "cancel_rate": rate("Cancelled"), "divert_rate": rate("Diverted"),
    }


# ---------------------------------------------------------------------------
# A1 / A29 global KPIs
# ---------------------------------------------------------------------------
def kpi_overview(feat: DataFrame) -> DataFrame:
    """A1: one row of headline KPIs over all rows."""
    return feat.agg(
        size().alias("total_flights"),
        mean(ARR).alias("avg_arr_delay"),
        rate("IsArrDelayed").alias("arr_delay_rate"),
        rate("Cancelled").alias("cancel_rate"),
        rate("Diverted").alias("divert_rate"),
        share_if(F.col(ARR) <= 15).alias("on_time_rate"),
    )


def ontime_summary(feat: DataFrame) -> DataFrame:
    """A29 (+P-6, P-7): on-time / early / late / cancelled / diverted counts and shares."""
    n = size()
    conds = {
        "on_time": F.col(ARR) <= 15, "early": F.col(ARR) < 0, "late": F.col(ARR) > 15,
        "cancelled": F.col("Cancelled") == 1, "diverted": F.col("Diverted") == 1,
    }
    cols = [n.alias("total_flights")]
    for k, c in conds.items():
        cols.append(F.count_if(F.coalesce(c, F.lit(False))).alias(f"{k}_flights"))
        cols.append(share_if(c).alias(f"{k}_share"))
    return feat.agg(*cols)


# ---------------------------------------------------------------------------
# A2, A3, A4, A6, A7, A8 profiles
# ---------------------------------------------------------------------------
def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A2: null count per column in one pass, returned long (column_name, nulls, total_rows)."""
    columns = columns or df.columns
    wide = df.agg(size().alias("__n"), *[(size() - F.count(F.col(c))).alias(f"__n_{i}")
                                         for i, c in enumerate(columns)])
    pairs = ", ".join(f"'{c}', `__n_{i}`" for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, null_count)",
                           "__n AS total_rows")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A3: count/mean/std/min/quartiles/max per column, exact quartiles, long form."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.percentile(x, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias(f"q{i}"),
                 F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("count"),
                     F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                     F.col(f"lo{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"),
                     F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
                     F.col(f"hi{i}").alias("max")) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


PERCENTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def delay_percentiles(feat: DataFrame, col: str = ARR, probs: list[float] = PERCENTILES,
                      exact: bool = True) -> DataFrame:
    """A4: linear-interpolated quantiles (nulls skipped), one row per probability."""
    arr = F.array(*[F.lit(p) for p in probs])
    q = F.percentile(F.col(col), arr) if exact else F.percentile_approx(F.col(col), arr, 10000)
    return (feat.agg(q.alias("q"))
                .select(F.posexplode("q").alias("i", "delay_minutes"))
                .select((F.element_at(arr, F.col("i") + 1)).alias("probability"),
                        F.format_string("%d%%", F.round(F.element_at(arr, F.col("i") + 1) * 100).cast("int")).alias("percentile"),
                        F.col("delay_minutes").cast("double").alias("delay_minutes")))


def dataset_extent(feat: DataFrame) -> DataFrame:
    """Distinct airlines / routes and the date range."""
    return feat.agg(size().alias("total_flights"),
                    F.countDistinct("Airline").alias("n_airlines"),
                    F.countDistinct("Origin", "Dest").alias("n_routes"),
                    F.min("FlightDate").alias("first_date"), F.max("FlightDate").alias("last_date"))


def dimension_values(feat: DataFrame, dims=("Airline", "Origin", "Dest")) -> DataFrame:
    """Sorted distinct values of each dimension (long form)."""
    pairs = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in dims)
    return (feat.selectExpr(f"stack({len(dims)}, {pairs}) AS (dimension, value)")
                .filter(F.col("value").isNotNull()).distinct().orderBy("dimension", "value"))


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min / max / median per numeric column in one pass, long form."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.median(x).alias(f"md{i}")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', lo{i}, hi{i}, md{i}" for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) AS (feature, min_value, max_value, median_value)")


# ---------------------------------------------------------------------------
# A9-A24 keyed summaries
# ---------------------------------------------------------------------------
def daily_delays(feat: DataFrame, exact: bool = True) -> DataFrame:
    """Per-day summary plus calendar attributes of the day."""
    m = standard_measures(exact)
    m.update({"cancel_rate": rate("Cancelled"), "divert_rate": rate("Diverted"), "total_flights": size()})
    d = F.col("FlightDate")
    return (group(feat, ["FlightDate"], m)
            .withColumns({"Year": F.year(d), "Month": F.month(d), "MonthName": F.date_format(d, "MMMM"),
                          "DayOfWeek": F.weekday(d), "DayOfWeekName": F.date_format(d, "EEEE"),
                          "WeekOfYear": F.weekofyear(d)})
            .orderBy("FlightDate"))


def hour_weekday(feat: DataFrame) -> DataFrame:
    """A10: (weekday name, departure hour) grid, weekday in logical order."""
    m = {"avg_arr_delay": mean(ARR), "avg_dep_delay": mean(DEP),
         "arr_delay_rate": rate("IsArrDelayed"), "dep_delay_rate": rate("IsDepDelayed"),
         "total_flights": size()}
    return group(feat, ["DayOfWeekName", "DepHour"], m).orderBy(order_expr("DayOfWeekName", WEEKDAYS), "DepHour")


def airline_performance(feat: DataFrame, min_flights: int = 1000, exact: bool = True) -> DataFrame:
    """A11 (+J2 folded): per-airline summary, HAVING size >= min_flights, worst first."""
    m = standard_measures(exact)
    m.update({"cancel_rate": rate("Cancelled"), "total_flights": size()})
    return (group(feat, ["Airline"], m).filter(F.col("total_flights") >= min_flights)
            .orderBy(F.col("avg_arr_delay").desc_nulls_last(), "Airline"))


def airline_delays_eda(feat: DataFrame, exact: bool = True) -> DataFrame:
    """Notebook airline table (count of non-null arrival delays)."""
    return group(feat, ["Airline"], eda_measures(exact)).orderBy(F.col("avg_arr_delay").desc_nulls_last(), "Airline")


def route_performance(feat: DataFrame, min_flights: int = 100, exact: bool = True) -> DataFrame:
    """A13 (+J1 folded, F22): per-route summary with label, HAVING size >= min_flights."""
    m = {"avg_arr_delay": mean(ARR), "median_arr_delay": median(ARR, exact),
         "arr_delay_rate": rate("IsArrDelayed"), "total_flights": size(),
         "cancel_rate": rate("Cancelled")}
    return (group(feat, ["Origin", "Dest"], m).filter(F.col("total_flights") >= min_flights)
            .withColumn("Route", F.concat_ws(" → ", "Origin", "Dest"))
            .orderBy(F.col("avg_arr_delay").desc_nulls_last(), "Origin", "Dest"))


def route_top_eda(feat: DataFrame, min_flights: int = 100, k: int = 15,
                  count_col: str = "FlightNumber") -> DataFrame:
    """Notebook route ranking (count of a flight-number column), top k."""
    m = {"avg_delay": mean(ARR), "flight_count": F.count(F.col(count_col))}
    return (group(feat, ["Origin", "Dest"], m).filter(F.col("flight_count") >= min_flights)
            .withColumn("route_label", F.concat_ws("-", "Origin", "Dest"))
            .orderBy(F.col("avg_delay").desc_nulls_last(), "Origin", "Dest").limit(k))


def weekday_delays(feat: DataFrame, exact: bool = True) -> DataFrame:
    """A15 + A20 (+ page view): weekday summary in Monday..Sunday order."""
    m = eda_measures(exact)
    m.update({"std_arr_delay": F.stddev_samp(ARR), "arr_delay_rate_pct": rate("IsArrDelayed") * 100,
              "total_flights": size()})
    return (group(feat, ["DayOfWeekName", "DayOfWeek"], m)
            .orderBy("DayOfWeek"))


def timeofday_delays(feat: DataFrame, exact: bool = True) -> DataFrame:
    """Time-of-day summary (notebook measures + page measures)."""
    m = eda_measures(exact)
    m.update({"arr_delay_rate_pct": rate("IsArrDelayed") * 100, "total_flights": size()})
    return group(feat, ["DepTimeOfDay"], m).orderBy(order_expr("DepTimeOfDay", TIME_OF_DAY))


def hour_delays(feat: DataFrame) -> DataFrame:
    """Per departure hour mean, std, counts and delay rate."""
    m = {"avg_arr_delay": mean(ARR), "std_arr_delay": F.stddev_samp(ARR),
         "arr_count": F.count(F.col(ARR)), "arr_delay_rate": rate("IsArrDelayed"), "total_flights": size()}
    return group(feat, ["DepHour"], m).orderBy("DepHour")


def month_delays(feat: DataFrame, exact: bool = True) -> DataFrame:
    """Per month (name, logical order): notebook + page measures."""
    m = {"avg_arr_delay": mean(ARR), "median_arr_delay": median(ARR, exact),
         "flight_count": F.count(F.col(ARR)), "cancel_rate": rate("Cancelled"),
         "arr_delay_rate_pct": rate("IsArrDelayed") * 100, "cancel_rate_pct": rate("Cancelled") * 100,
         "total_flights": size()}
    return group(feat, ["Month", "MonthName"], m).orderBy("Month")


def year_delays(feat: DataFrame) -> DataFrame:
    """Per year mean, std, count; page measures."""
    m = {"avg_arr_delay": mean(ARR), "std_arr_delay": F.stddev_samp(ARR), "flight_count": F.count(F.col(ARR)),
         "arr_delay_rate_pct": rate("IsArrDelayed") * 100, "cancel_rate_pct": rate("Cancelled") * 100,
         "total_flights": size()}
    return group(feat, ["Year"], m).orderBy("Year")


def airport_delays(feat: DataFrame, min_flights: int = 500, k: int = 20) -> DataFrame:
    """Worst origin and destination airports (>= min_flights non-null delays), top k each.

    Both sides come from one pass: each row is emitted once as origin and once
    as destination (``stack``) and aggregated by (side, airport) together.
    """
    both = feat.select(F.expr("stack(2, 'origin', OriginAirportID, 'dest', DestAirportID) AS (side, AirportID)"),
                       F.col(ARR))
    agg = group(both, ["side", "AirportID"], {"avg_arr_delay": mean(ARR), "flight_count": F.count(F.col(ARR))})
    return top_k_per_group(agg.filter(F.col("flight_count") >= min_flights), ["side"],
                           [F.col("avg_arr_delay").desc_nulls_last(), F.col("AirportID")], k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Rank inside each key group and keep the first k (a small aggregate input)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------------------
# A25 two-level, A26 category share, A28 periods
# ---------------------------------------------------------------------------
def monthly_from_daily(daily: DataFrame, cols=("avg_arr_delay", "arr_delay_rate", "cancel_rate")) -> DataFrame:
    """Unweighted mean of daily values per month name (years merged)."""
    return (daily.groupBy("MonthName").agg(*[F.avg(c).alias(c) for c in cols])
                 .orderBy(order_expr("MonthName", MONTHS)))


def category_distribution(feat: DataFrame, by: str, category_col: str = "ArrDelayCategory",
                          categories: list[str] = DELAY_CATEGORIES, drop: tuple[str, ...] = (),
                          min_rows: int = 1) -> DataFrame:
    """Percent of each delay category within each group, pivoted.

    Written as conditional aggregation: one pass, one shuffle, no window and no
    pivot job (the category list is fixed).  Absent categories are 0; ``drop``
    removes columns after the shares are computed (so rows may not sum to 100);
    groups below ``min_rows`` rows go.
    """
    n = size()
    cols = [(F.count_if(F.col(category_col) == c) * 100.0 / n).alias(c) for c in categories if c not in drop]
    out = _keys_not_null(feat, [by]).groupBy(by).agg(*cols, n.alias("__rows"))
    return out.filter(F.col("__rows") >= min_rows).drop("__rows")


def period_compare(feat: DataFrame, periods: dict[str, list[int]]) -> DataFrame:
    """A28/F32/P-12: KPIs for labelled year groups."""
    label = None
    for name, years in periods.items():
        cond = F.col("Year").isin(years)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    m = {"avg_delay": mean(ARR), "delay_rate_pct": rate("IsArrDelayed") * 100,
         "cancel_rate_pct": rate("Cancelled") * 100, "flights": size()}
    return group(feat.withColumn("period", label), ["period"], m).orderBy("period")


# ---------------------------------------------------------------------------
# A5 category shares, A21-A23 binned summaries
# ---------------------------------------------------------------------------
def category_share(feat: DataFrame, exclude_unknown: bool = False) -> DataFrame:
    """A5 (+P-10): value counts of arrival and departure categories in logical
    order with percent of all rows (one pass: both columns stacked)."""
    long = feat.select(F.expr("stack(2, 'arrival', ArrDelayCategory, 'departure', DepDelayCategory) AS (delay_type, category)"))
    total = F.sum("flights").over(Window.partitionBy("delay_type"))
    out = (long.groupBy("delay_type", "category").agg(size().alias("flights"))
               .withColumn("pct_of_rows", F.col("flights") * 100.0 / total))
    if exclude_unknown:
        out = out.filter(F.col("category") != "Unknown")
    return out.withColumn("category_order", order_expr("category", DELAY_CATEGORIES)) \
              .orderBy("delay_type", "category_order")


def dense_bins(spark, agg: DataFrame, bin_col: str, labels: list[str], fill: dict | None = None) -> DataFrame:
    """Restore empty bins in label order from a tiny fixed dimension."""
    from punctual.schema import order_dim
    dim = order_dim(spark, bin_col, labels, "bin_order")
    # ``agg`` is keyed by the bin label, so it has at most len(labels) rows.
    out = dim.join(F.broadcast(agg), bin_col, "left")
    if fill:
        out = out.fillna(fill)
    return out.orderBy("bin_order").drop("bin_order")


def distance_by_category(feat: DataFrame, spark, distance_col: str = "Distance",
                         exact: bool = True) -> DataFrame:
    """Distance mean/median/count per late category (rows with a null
    distance or delay dropped), all five categories listed in fixed order."""
    base = feat.filter(F.col(distance_col).isNotNull() & F.col(ARR).isNotNull() & F.col(DEP).isNotNull()) \
               .filter(F.col("ArrDelayCategory").isin(LATE_CATEGORIES))
    agg = base.groupBy("ArrDelayCategory").agg(F.avg(distance_col).alias("mean_distance"),
                                               median(distance_col, exact).alias("median_distance"),
                                               F.count(F.col(distance_col)).alias("flights"))
    return dense_bins(spark, agg, "ArrDelayCategory", LATE_CATEGORIES, {"flights": 0})
