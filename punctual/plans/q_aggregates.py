"""Registered aggregation / filter / feature queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import features as fx
from punctual.operators import aggregates as A
from punctual.operators import filters as P
from punctual.plans.catalog import features, register
from punctual.plans.sql import duration_sql, q, r6
from punctual.schema import DELAY_CATEGORIES, LATE_CATEGORIES
from punctual.sources.flights import flights

# ---------------------------------------------------------------------------
# Parameters of the registered examples (the reference's dashboard defaults
# where it has them; otherwise a representative choice for the test tables).
# ---------------------------------------------------------------------------
AIRLINE_MIN_FLIGHTS = 1000
ROUTE_MIN_FLIGHTS = 100
EXPLORE = dict(date_range=("1996-01-01", "2000-12-31"),
               airlines=["Brand#11", "Brand#23", "Brand#35", "Brand#42", "Brand#54"],
               weekdays=["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"],
               times_of_day=["Morning (6-12)", "Afternoon (12-18)"],
               distance_range=(500, 2500))
# Year groups of the period comparison, mapped onto the years of the test data.
PERIODS = {"1995-1997": [1995, 1996, 1997], "1998-1999": [1998, 1999], "2000-2001": [2000, 2001]}
RAW_COLUMNS = ["FlightKey", "FlightDate", "Airline", "Origin", "Dest", "OriginAirportID", "DestAirportID",
               "FlightNumber", "CRSDepTime", "CRSArrTime", "Distance", "TaxiOut", "TaxiIn", "Cancelled",
               "Diverted", "DepDelayMinutes", "ArrDelayMinutes", "DepTime", "ArrTime"]
DESCRIBE_COLUMNS = ["ArrDelayMinutes", "DepDelayMinutes", "TaxiOut", "TaxiIn", "Distance"]
RANGE_COLUMNS = ["Distance", "CRSDepTime", "TaxiOut", "TaxiIn", "DepHour"]


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---------------------------------------------------------------------------
# A11 airline performance (flagship)
# ---------------------------------------------------------------------------
@register("airline_performance", q(f"""
SELECT Airline, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('avg(DepDelayMinutes)', 'avg_dep_delay')},
       {r6('quantile_cont(ArrDelayMinutes, 0.5)', 'median_arr_delay')},
       {r6('quantile_cont(DepDelayMinutes, 0.5)', 'median_dep_delay')},
       {r6('avg(IsArrDelayed)', 'arr_delay_rate')}, {r6('avg(IsDepDelayed)', 'dep_delay_rate')},
       {r6('avg(Cancelled)', 'cancel_rate')}, count(*) AS total_flights
FROM features WHERE Airline IS NOT NULL GROUP BY Airline HAVING count(*) >= {AIRLINE_MIN_FLIGHTS}"""))
def airline_performance(spark, sf_dir):
    return A.airline_performance(features(spark, sf_dir), min_flights=AIRLINE_MIN_FLIGHTS)


# ---------------------------------------------------------------------------
# A1 KPIs, P-1..P-4 explore filter, A29 on-time summary
# ---------------------------------------------------------------------------
@register("kpi_overview", q(f"""
SELECT count(*) AS total_flights, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')},
       {r6('avg(IsArrDelayed)', 'arr_delay_rate')}, {r6('avg(Cancelled)', 'cancel_rate')},
       {r6('avg(Diverted)', 'divert_rate')},
       {r6('count_if(ArrDelayMinutes <= 15) / count(*)', 'on_time_rate')}
FROM features"""))
def kpi_overview(spark, sf_dir):
    return A.kpi_overview(features(spark, sf_dir))


_E = EXPLORE
_KEEP = (f"COALESCE(FlightDate BETWEEN DATE '{_E['date_range'][0]}' AND DATE '{_E['date_range'][1]}' "
         f"AND Airline IN ({_in(_E['airlines'])}) AND DayOfWeekName IN ({_in(_E['weekdays'])}) "
         f"AND DepTimeOfDay IN ({_in(_E['times_of_day'])}) "
         f"AND Distance BETWEEN {_E['distance_range'][0]} AND {_E['distance_range'][1]}, false)")


@register("explore_filter", q(f"""
, k AS (SELECT *, {_KEEP} AS keep FROM features)
SELECT CAST(count_if(keep) AS BIGINT) AS kept_flights, {r6('count_if(keep) / count(*)', 'kept_share')},
       {r6('avg(CASE WHEN keep THEN ArrDelayMinutes END)', 'avg_arr_delay')},
       {r6('avg(CASE WHEN keep THEN IsArrDelayed END)', 'arr_delay_rate')},
       {r6('avg(CASE WHEN keep THEN Cancelled END)', 'cancel_rate')},
       {r6('avg(CASE WHEN keep THEN Diverted END)', 'divert_rate')},
       {r6('count_if(keep AND COALESCE(ArrDelayMinutes <= 15, false)) / nullif(count_if(keep), 0)', 'on_time_rate')}
FROM k""".replace("\n, k AS", ", k AS", 1)))
def explore_filter(spark, sf_dir):
    return P.filtered_kpis(features(spark, sf_dir), P.explore_predicate(**EXPLORE))


_ONTIME = {"on_time": "ArrDelayMinutes <= 15", "early": "ArrDelayMinutes < 0", "late": "ArrDelayMinutes > 15",
           "cancelled": "Cancelled = 1", "diverted": "Diverted = 1"}


@register("ontime_summary", q("SELECT count(*) AS total_flights, " + ", ".join(
    f"CAST(count_if({c}) AS BIGINT) AS {k}_flights, {r6(f'count_if({c}) / count(*)', f'{k}_share')}" for k, c in _ONTIME.items())
    + " FROM features"))
def ontime_summary(spark, sf_dir):
    return A.ontime_summary(features(spark, sf_dir))


# ---------------------------------------------------------------------------
# A2 null profile, A3 describe, A4 percentiles, A6 extent, A7 values, A8 ranges
# ---------------------------------------------------------------------------
@register("null_profile", q(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS total_rows FROM flights"
    for c in RAW_COLUMNS)))
def null_profile(spark, sf_dir):
    return A.null_profile(flights(spark, sf_dir).select(*RAW_COLUMNS), RAW_COLUMNS)


@register("describe_delays", q(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS "count", {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')},
        {r6(f'min({c})', '"min"')}, {r6(f'quantile_cont({c}, 0.25)', 'p25')}, {r6(f'quantile_cont({c}, 0.5)', 'p50')},
        {r6(f'quantile_cont({c}, 0.75)', 'p75')}, {r6(f'max({c})', '"max"')} FROM features"""
    for c in DESCRIBE_COLUMNS)))
def describe_delays(spark, sf_dir):
    return A.describe(features(spark, sf_dir), DESCRIBE_COLUMNS)


@register("delay_percentiles", q(" UNION ALL ".join(
    f"SELECT {r6(f'CAST({p} AS DOUBLE)', 'probability')}, '{round(p * 100)}%' AS percentile, "
    f"{r6(f'quantile_cont(ArrDelayMinutes, {p})', 'delay_minutes')} FROM features" for p in A.PERCENTILES)))
def delay_percentiles(spark, sf_dir):
    return A.delay_percentiles(features(spark, sf_dir))


@register("dataset_extent", q("""
SELECT count(*) AS total_flights, count(DISTINCT Airline) AS n_airlines,
       (SELECT count(*) FROM (SELECT DISTINCT Origin, Dest FROM features
                              WHERE Origin IS NOT NULL AND Dest IS NOT NULL)) AS n_routes,
       min(FlightDate) AS first_date, max(FlightDate) AS last_date
FROM features"""))
def dataset_extent(spark, sf_dir):
    return A.dataset_extent(features(spark, sf_dir))


@register("dimension_values", q(" UNION ALL ".join(
    f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM features WHERE {d} IS NOT NULL"
    for d in ("Airline", "Origin", "Dest"))))
def dimension_values(spark, sf_dir):
    return A.dimension_values(features(spark, sf_dir))


@register("feature_ranges", q(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'min({c})', 'min_value')}, {r6(f'max({c})', 'max_value')}, "
    f"{r6(f'quantile_cont({c}, 0.5)', 'median_value')} FROM features" for c in RANGE_COLUMNS)))
def feature_ranges(spark, sf_dir):
    return A.feature_ranges(features(spark, sf_dir), RANGE_COLUMNS)


# ---------------------------------------------------------------------------
# A9 daily, A10 hour x weekday, A12, A13, A14
# ---------------------------------------------------------------------------
_STD = (f"{r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('avg(DepDelayMinutes)', 'avg_dep_delay')}, "
        f"{r6('quantile_cont(ArrDelayMinutes, 0.5)', 'median_arr_delay')}, "
        f"{r6('quantile_cont(DepDelayMinutes, 0.5)', 'median_dep_delay')}, "
        f"{r6('avg(IsArrDelayed)', 'arr_delay_rate')}, {r6('avg(IsDepDelayed)', 'dep_delay_rate')}")
_EDA = (f"{r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('quantile_cont(ArrDelayMinutes, 0.5)', 'median_arr_delay')}, "
        f"count(ArrDelayMinutes) AS flight_count, {r6('avg(DepDelayMinutes)', 'avg_dep_delay')}, "
        f"{r6('quantile_cont(DepDelayMinutes, 0.5)', 'median_dep_delay')}, "
        f"{r6('avg(Cancelled)', 'cancel_rate')}, {r6('avg(Diverted)', 'divert_rate')}")


@register("daily_delays", q(f"""
SELECT *, CAST(year(FlightDate) AS INT) AS Year, CAST(month(FlightDate) AS INT) AS Month,
       monthname(FlightDate) AS MonthName, CAST(isodow(FlightDate) - 1 AS INT) AS DayOfWeek,
       dayname(FlightDate) AS DayOfWeekName, CAST(weekofyear(FlightDate) AS INT) AS WeekOfYear
FROM (SELECT FlightDate, {_STD}, {r6('avg(Cancelled)', 'cancel_rate')}, {r6('avg(Diverted)', 'divert_rate')},
             count(*) AS total_flights
      FROM features WHERE FlightDate IS NOT NULL GROUP BY FlightDate)"""))
def daily_delays(spark, sf_dir):
    return A.daily_delays(features(spark, sf_dir))


@register("hour_weekday", q(f"""
SELECT DayOfWeekName, DepHour, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('avg(DepDelayMinutes)', 'avg_dep_delay')},
       {r6('avg(IsArrDelayed)', 'arr_delay_rate')}, {r6('avg(IsDepDelayed)', 'dep_delay_rate')}, count(*) AS total_flights
FROM features WHERE DayOfWeekName IS NOT NULL AND DepHour IS NOT NULL GROUP BY DayOfWeekName, DepHour"""))
def hour_weekday(spark, sf_dir):
    return A.hour_weekday(features(spark, sf_dir))


@register("airline_delays_eda", q(f"SELECT Airline, {_EDA} FROM features WHERE Airline IS NOT NULL GROUP BY Airline"))
def airline_delays_eda(spark, sf_dir):
    return A.airline_delays_eda(features(spark, sf_dir))


@register("route_performance", q(f"""
SELECT Origin, Dest, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('quantile_cont(ArrDelayMinutes, 0.5)', 'median_arr_delay')},
       {r6('avg(IsArrDelayed)', 'arr_delay_rate')}, count(*) AS total_flights, {r6('avg(Cancelled)', 'cancel_rate')},
       concat_ws(' → ', Origin, Dest) AS Route
FROM features WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest
HAVING count(*) >= {ROUTE_MIN_FLIGHTS}"""))
def route_performance(spark, sf_dir):
    return A.route_performance(features(spark, sf_dir), min_flights=ROUTE_MIN_FLIGHTS)


@register("route_top_eda", q(f"""
SELECT Origin, Dest, {r6('m', 'avg_delay')}, flight_count, concat_ws('-', Origin, Dest) AS route_label
FROM (SELECT Origin, Dest, avg(ArrDelayMinutes) AS m, count(FlightNumber) AS flight_count
      FROM features WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest
      HAVING count(FlightNumber) >= 100)
ORDER BY m DESC NULLS LAST, Origin, Dest LIMIT 15"""))
def route_top_eda(spark, sf_dir):
    return A.route_top_eda(features(spark, sf_dir))


# ---------------------------------------------------------------------------
# A15-A20 calendar / clock summaries
# ---------------------------------------------------------------------------
@register("weekday_delays", q(f"""
SELECT DayOfWeekName, DayOfWeek, {_EDA}, {r6('stddev_samp(ArrDelayMinutes)', 'std_arr_delay')},
       {r6('avg(IsArrDelayed) * 100', 'arr_delay_rate_pct')}, count(*) AS total_flights
FROM features WHERE DayOfWeekName IS NOT NULL AND DayOfWeek IS NOT NULL GROUP BY DayOfWeekName, DayOfWeek"""))
def weekday_delays(spark, sf_dir):
    return A.weekday_delays(features(spark, sf_dir))


@register("timeofday_delays", q(f"""
SELECT DepTimeOfDay, {_EDA}, {r6('avg(IsArrDelayed) * 100', 'arr_delay_rate_pct')}, count(*) AS total_flights
FROM features WHERE DepTimeOfDay IS NOT NULL GROUP BY DepTimeOfDay"""))
def timeofday_delays(spark, sf_dir):
    return A.timeofday_delays(features(spark, sf_dir))


@register("hour_delays", q(f"""
SELECT DepHour, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('stddev_samp(ArrDelayMinutes)', 'std_arr_delay')},
       count(ArrDelayMinutes) AS arr_count, {r6('avg(IsArrDelayed)', 'arr_delay_rate')}, count(*) AS total_flights
FROM features WHERE DepHour IS NOT NULL GROUP BY DepHour"""))
def hour_delays(spark, sf_dir):
    return A.hour_delays(features(spark, sf_dir))


@register("month_delays", q(f"""
SELECT Month, MonthName, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('quantile_cont(ArrDelayMinutes, 0.5)', 'median_arr_delay')},
       count(ArrDelayMinutes) AS flight_count, {r6('avg(Cancelled)', 'cancel_rate')},
       {r6('avg(IsArrDelayed) * 100', 'arr_delay_rate_pct')}, {r6('avg(Cancelled) * 100', 'cancel_rate_pct')},
       count(*) AS total_flights
FROM features WHERE Month IS NOT NULL AND MonthName IS NOT NULL GROUP BY Month, MonthName"""))
def month_delays(spark, sf_dir):
    return A.month_delays(features(spark, sf_dir))


@register("year_delays", q(f"""
SELECT Year, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('stddev_samp(ArrDelayMinutes)', 'std_arr_delay')},
       count(ArrDelayMinutes) AS flight_count, {r6('avg(IsArrDelayed) * 100', 'arr_delay_rate_pct')},
       {r6('avg(Cancelled) * 100', 'cancel_rate_pct')}, count(*) AS total_flights
FROM features WHERE Year IS NOT NULL GROUP BY Year"""))
def year_delays(spark, sf_dir):
    return A.year_delays(features(spark, sf_dir))


@register("airport_delays", q(f"""
, s AS (SELECT 'origin' AS side, OriginAirportID AS AirportID, ArrDelayMinutes FROM features
        UNION ALL SELECT 'dest' AS side, DestAirportID AS AirportID, ArrDelayMinutes FROM features),
a AS (SELECT side, AirportID, avg(ArrDelayMinutes) AS m, count(ArrDelayMinutes) AS flight_count
      FROM s WHERE AirportID IS NOT NULL GROUP BY side, AirportID HAVING count(ArrDelayMinutes) >= 500),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY m DESC NULLS LAST, AirportID) AS rk FROM a)
SELECT side, AirportID, {r6('m', 'avg_arr_delay')}, flight_count, CAST(rk AS INT) AS rank FROM r WHERE rk <= 20"""
                                   .replace("\n, s AS", ", s AS", 1)))
def airport_delays(spark, sf_dir):
    return A.airport_delays(features(spark, sf_dir))


@register("monthly_from_daily", q(f"""
, d AS (SELECT FlightDate, avg(ArrDelayMinutes) AS avg_arr_delay, avg(IsArrDelayed) AS arr_delay_rate,
               avg(Cancelled) AS cancel_rate FROM features WHERE FlightDate IS NOT NULL GROUP BY FlightDate)
SELECT monthname(FlightDate) AS MonthName, {r6('avg(avg_arr_delay)', 'avg_arr_delay')},
       {r6('avg(arr_delay_rate)', 'arr_delay_rate')}, {r6('avg(cancel_rate)', 'cancel_rate')}
FROM d GROUP BY monthname(FlightDate)""".replace("\n, d AS", ", d AS", 1)))
def monthly_from_daily(spark, sf_dir):
    return A.monthly_from_daily(A.daily_delays(features(spark, sf_dir)))


# ---------------------------------------------------------------------------
# A26 category distribution pivots, A5 category share, A28 periods, A23
# ---------------------------------------------------------------------------
def _cat_dist_sql(by: str) -> str:
    cols = ", ".join(r6(f"CAST(count_if(ArrDelayCategory = '{c}') AS DOUBLE) * 100 / count(*)", f'"{c}"')
                     for c in DELAY_CATEGORIES)
    return q(f"SELECT {by}, {cols} FROM features WHERE {by} IS NOT NULL GROUP BY {by}")


@register("category_dist_airline", _cat_dist_sql("Airline"))
def category_dist_airline(spark, sf_dir):
    return A.category_distribution(features(spark, sf_dir), "Airline")


@register("category_dist_tod", _cat_dist_sql("DepTimeOfDay"))
def category_dist_tod(spark, sf_dir):
    return A.category_distribution(features(spark, sf_dir), "DepTimeOfDay")


_CAT_ORDER = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(DELAY_CATEGORIES))


@register("category_share", q(f"""
, l AS (SELECT 'arrival' AS delay_type, ArrDelayCategory AS category FROM features
        UNION ALL SELECT 'departure' AS delay_type, DepDelayCategory AS category FROM features),
g AS (SELECT delay_type, category, count(*) AS flights FROM l GROUP BY delay_type, category)
SELECT delay_type, category, flights,
       {r6('flights * 100.0 / sum(flights) OVER (PARTITION BY delay_type)', 'pct_of_rows')},
       CAST(CASE category {_CAT_ORDER} END AS INT) AS category_order
FROM g""".replace("\n, l AS", ", l AS", 1)))
def category_share(spark, sf_dir):
    return A.category_share(features(spark, sf_dir))


_PERIOD_CASE = "CASE " + " ".join(f"WHEN Year IN ({', '.join(map(str, ys))}) THEN '{p}'"
                                  for p, ys in PERIODS.items()) + " END"


@register("period_compare", q(f"""
SELECT period, {r6('avg(ArrDelayMinutes)', 'avg_delay')}, {r6('avg(IsArrDelayed) * 100', 'delay_rate_pct')},
       {r6('avg(Cancelled) * 100', 'cancel_rate_pct')}, count(*) AS flights
FROM (SELECT *, {_PERIOD_CASE} AS period FROM features) WHERE period IS NOT NULL GROUP BY period"""))
def period_compare(spark, sf_dir):
    return A.period_compare(features(spark, sf_dir), PERIODS)


_LATE_DIM = ", ".join(f"('{c}', {i})" for i, c in enumerate(LATE_CATEGORIES))


@register("distance_by_category", q(f"""
, a AS (SELECT ArrDelayCategory, avg(Distance) AS m, quantile_cont(Distance, 0.5) AS md, count(Distance) AS n
        FROM features WHERE Distance IS NOT NULL AND ArrDelayMinutes IS NOT NULL AND DepDelayMinutes IS NOT NULL
        GROUP BY ArrDelayCategory)
SELECT d.ArrDelayCategory, {r6('a.m', 'mean_distance')}, {r6('a.md', 'median_distance')},
       COALESCE(a.n, 0) AS flights
FROM (VALUES {_LATE_DIM}) AS d(ArrDelayCategory, o) LEFT JOIN a ON a.ArrDelayCategory = d.ArrDelayCategory"""
                                         .replace("\n, a AS", ", a AS", 1)))
def distance_by_category(spark, sf_dir):
    return A.distance_by_category(features(spark, sf_dir), spark)


# ---------------------------------------------------------------------------
# Feature checks over the whole table
# ---------------------------------------------------------------------------
@register("features_temporal", q("""
SELECT FlightDate, Year, Month, MonthName, DayOfWeek, DayOfWeekName, WeekOfYear,
       CAST(quarter(FlightDate) AS INT) AS Quarter, CAST(dayofmonth(FlightDate) AS INT) AS DayofMonth,
       substring(DayOfWeekName, 1, 3) AS ShortWeekday, count(*) AS flights
FROM features GROUP BY ALL"""))
def features_temporal(spark, sf_dir):
    f = features(spark, sf_dir)
    d = F.col("FlightDate")
    return (f.groupBy("FlightDate", "Year", "Month", "MonthName", "DayOfWeek", "DayOfWeekName", "WeekOfYear")
             .agg(F.count(F.lit(1)).alias("flights"))
             .withColumns({"Quarter": F.quarter(d), "DayofMonth": F.dayofmonth(d),
                           "ShortWeekday": fx.short_weekday(d)}))


@register("features_clock", q("""
SELECT DepHour, DepTimeOfDay,
       CASE WHEN DepHour < 6 THEN 'Night' WHEN DepHour < 12 THEN 'Morning' WHEN DepHour < 18 THEN 'Afternoon'
            ELSE 'Evening' END AS ServingTimeOfDay,
       printf('%02d00-%02d59', DepHour, DepHour) AS DepTimeBlk, count(*) AS flights
FROM features GROUP BY ALL"""))
def features_clock(spark, sf_dir):
    f = features(spark, sf_dir).withColumns({"ServingTimeOfDay": fx.serving_time_of_day("DepHour"),
                                             "DepTimeBlk": fx.dep_time_block("DepHour")})
    return f.groupBy("DepHour", "DepTimeOfDay", "ServingTimeOfDay", "DepTimeBlk").agg(
        F.count(F.lit(1)).alias("flights"))


@register("distance_groups", q("""
SELECT CAST(least(floor(Distance / 250) + 1, 11) AS INT) AS DistanceGroup, count(*) AS flights,
       min(Distance) AS min_distance, max(Distance) AS max_distance
FROM features WHERE Distance IS NOT NULL GROUP BY ALL"""))
def distance_groups(spark, sf_dir):
    f = features(spark, sf_dir).filter(F.col("Distance").isNotNull())
    return f.groupBy(fx.distance_group("Distance").alias("DistanceGroup")).agg(
        F.count(F.lit(1)).alias("flights"), F.min("Distance").alias("min_distance"),
        F.max("Distance").alias("max_distance"))


@register("delay_categories", q("""
SELECT 'arrival' AS delay_type, ArrDelayCategory AS category, IsArrDelayed AS is_delayed, count(*) AS flights,
       min(ArrDelayMinutes) AS min_delay, max(ArrDelayMinutes) AS max_delay FROM features GROUP BY ALL
UNION ALL
SELECT 'departure', DepDelayCategory, IsDepDelayed, count(*), min(DepDelayMinutes), max(DepDelayMinutes)
FROM features GROUP BY ALL"""))
def delay_categories(spark, sf_dir):
    f = features(spark, sf_dir)
    long = f.select(F.expr("stack(2, 'arrival', ArrDelayCategory, IsArrDelayed, ArrDelayMinutes, "
                           "'departure', DepDelayCategory, IsDepDelayed, DepDelayMinutes) "
                           "AS (delay_type, category, is_delayed, minutes)"))
    return long.groupBy("delay_type", "category", "is_delayed").agg(
        F.count(F.lit(1)).alias("flights"), F.min("minutes").alias("min_delay"), F.max("minutes").alias("max_delay"))


@register("features_duration", q(f"""
SELECT Origin, Dest, {r6('avg(ScheduledDuration)', 'avg_scheduled_duration')},
       {r6('avg(ActualDuration)', 'avg_actual_duration')}, count(ActualDuration) AS actual_count,
       min(ScheduledDuration) AS min_scheduled_duration, max(ScheduledDuration) AS max_scheduled_duration
FROM (SELECT *, {duration_sql('CRSDepTime', 'CRSArrTime')} AS ScheduledDuration,
             {duration_sql('DepTime', 'ArrTime')} AS ActualDuration FROM features)
WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest"""))
def features_duration(spark, sf_dir):
    f = features(spark, sf_dir).withColumns({
        "ScheduledDuration": fx.duration_minutes("CRSDepTime", "CRSArrTime"),
        "ActualDuration": fx.duration_minutes("DepTime", "ArrTime")})
    return A.group(f, ["Origin", "Dest"], {
        "avg_scheduled_duration": F.avg("ScheduledDuration"), "avg_actual_duration": F.avg("ActualDuration"),
        "actual_count": F.count("ActualDuration"), "min_scheduled_duration": F.min("ScheduledDuration"),
        "max_scheduled_duration": F.max("ScheduledDuration")})


@register("kpi_formatted", q("""
, k AS (SELECT count(*) AS n, avg(ArrDelayMinutes) AS d, avg(IsArrDelayed) * 100 AS r, avg(Cancelled) * 100 AS c,
               avg(CASE WHEN Airline = 'no such airline' THEN ArrDelayMinutes END) AS missing FROM features)
SELECT format('{:,}', n) AS total_flights, printf('%.1f min', d) AS avg_arr_delay, printf('%.1f%%', r) AS delay_rate,
       printf('%.2f%%', c) AS cancel_rate, CASE WHEN missing IS NULL THEN 'N/A' ELSE printf('%.1f', missing) END AS missing_metric
FROM k""".replace("\n, k AS", ", k AS", 1)))
def kpi_formatted(spark, sf_dir):
    """headline KPIs as display strings (null -> 'N/A')."""
    f = features(spark, sf_dir)
    k = f.agg(F.count(F.lit(1)).alias("n"), F.avg("ArrDelayMinutes").alias("d"),
              (F.avg("IsArrDelayed") * 100).alias("r"), (F.avg("Cancelled") * 100).alias("c"),
              F.avg(F.when(F.col("Airline") == "no such airline", F.col("ArrDelayMinutes"))).alias("missing"))
    return k.select(fx.format_metric("n", "count").alias("total_flights"),
                    fx.format_metric("d", "minutes").alias("avg_arr_delay"),
                    fx.format_metric("r", "percentage").alias("delay_rate"),
                    fx.format_metric("c", "percentage", 2).alias("cancel_rate"),
                    fx.format_metric("missing", "plain").alias("missing_metric"))


# ---------------------------------------------------------------------------
# The filtered dashboard views (P-1..P-3 before A11, A10, A13), P-10, cohort mix, W2
# ---------------------------------------------------------------------------
def _explored(spark, sf_dir):
    return P.apply_filter(features(spark, sf_dir), P.explore_predicate(**EXPLORE))


_KEPT = f"FROM (SELECT * FROM features WHERE {_KEEP})"


@register("explore_airlines", q(f"""
SELECT Airline, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('avg(IsArrDelayed)', 'arr_delay_rate')},
       {r6('avg(Cancelled)', 'cancel_rate')}, count(*) AS total_flights {_KEPT} WHERE Airline IS NOT NULL GROUP BY Airline"""))
def explore_airlines(spark, sf_dir):
    """Airline view of the filtered dashboard."""
    return A.airline_performance(_explored(spark, sf_dir), min_flights=1).select(
        "Airline", "avg_arr_delay", "arr_delay_rate", "cancel_rate", "total_flights")


@register("explore_routes", q(f"""
SELECT Origin, Dest, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, {r6('avg(IsArrDelayed)', 'arr_delay_rate')},
       {r6('avg(Cancelled)', 'cancel_rate')}, count(*) AS total_flights {_KEPT}
WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest"""))
def explore_routes(spark, sf_dir):
    """Route view of the filtered dashboard."""
    return A.route_performance(_explored(spark, sf_dir), min_flights=1).select(
        "Origin", "Dest", "avg_arr_delay", "arr_delay_rate", "cancel_rate", "total_flights")


@register("explore_hours", q(f"""
SELECT DayOfWeekName, DepHour, {r6('avg(ArrDelayMinutes)', 'avg_arr_delay')}, count(*) AS total_flights {_KEPT}
WHERE DayOfWeekName IS NOT NULL AND DepHour IS NOT NULL GROUP BY DayOfWeekName, DepHour"""))
def explore_hours(spark, sf_dir):
    """Weekday and hour view of the filtered dashboard."""
    return A.group(_explored(spark, sf_dir), ["DayOfWeekName", "DepHour"],
                   {"avg_arr_delay": A.mean("ArrDelayMinutes"), "total_flights": A.size()})


@register("category_share_known", q(f"""
, l AS (SELECT 'arrival' AS delay_type, ArrDelayCategory AS category FROM features
        UNION ALL SELECT 'departure' AS delay_type, DepDelayCategory AS category FROM features),
g AS (SELECT delay_type, category, count(*) AS flights FROM l GROUP BY delay_type, category),
s AS (SELECT delay_type, category, flights, {r6('flights * 100.0 / sum(flights) OVER (PARTITION BY delay_type)', 'pct_of_rows')},
       CAST(CASE category {_CAT_ORDER} END AS INT) AS category_order FROM g)
SELECT * FROM s WHERE category <> 'Unknown'""".replace("\n, l AS", ", l AS", 1)))
def category_share_known(spark, sf_dir):
    """P-10: category shares of all rows, without the unknown category."""
    return A.category_share(features(spark, sf_dir), exclude_unknown=True)


COHORT_MIN = 500


@register("category_dist_cohort", q(
    "SELECT Airline, " + ", ".join(
        r6(f"count_if(ArrDelayCategory = '{c}') * 100.0 / count(*)", f'"{c}"') for c in DELAY_CATEGORIES if c != "Unknown")
    + f" FROM features WHERE Airline IS NOT NULL GROUP BY Airline HAVING count(*) >= {COHORT_MIN}"))
def category_dist_cohort(spark, sf_dir):
    """Delay mix of the airlines with enough flights, unknown dropped after the shares are computed."""
    return A.category_distribution(features(spark, sf_dir), "Airline", drop=("Unknown",), min_rows=COHORT_MIN)


@register("average_ranks", q(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(v AS DOUBLE) AS value, cnt,
        {r6('sum(cnt) OVER (ORDER BY v) - (cnt - 1) / 2.0', 'rank')}
        FROM (SELECT {c} AS v, count(*) AS cnt FROM features WHERE {c} IS NOT NULL GROUP BY {c})"""
    for c in ("ArrDelayMinutes", "Distance"))))
def average_ranks(spark, sf_dir):
    """Average rank of every distinct value."""
    from punctual.operators.distribution import average_ranks as ranks
    return ranks(features(spark, sf_dir), ["ArrDelayMinutes", "Distance"])
