"""Registered pivot / ranking / tagged-union queries (V1, V2, O4, O5, P-15, J4, U3)."""

from __future__ import annotations

from punctual.operators import aggregates as A
from punctual.operators import reshape as R
from punctual.plans.catalog import features, register
from punctual.plans.sql import q, r6
from punctual.schema import DELAY_CATEGORIES

EXPLORE_AIRLINE_MIN = 100
EXPLORE_ROUTE_MIN = 50
INSIGHT_AIRLINE_MIN = 1000


def _rank_sql(src: str, cols: str, order: str, k: int, tag: str, tag_col: str = "ranking") -> str:
    return (f"SELECT '{tag}' AS {tag_col}, {cols}, CAST(rk AS INT) AS rank FROM "
            f"(SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM {src}) WHERE rk <= {k}")


@register("hour_weekday_pivot", q("SELECT DayOfWeekName, " + ", ".join(
    r6(f"avg(CASE WHEN DepHour = {h} THEN ArrDelayMinutes END)", f'"{h}"') for h in range(25))
    + " FROM features WHERE DayOfWeekName IS NOT NULL AND DepHour IS NOT NULL GROUP BY DayOfWeekName"))
def hour_weekday_pivot(spark, sf_dir):
    return R.hour_weekday_pivot(features(spark, sf_dir))


@register("calendar_pivot", q(f"""
, d AS (SELECT FlightDate, avg(ArrDelayMinutes) AS v FROM features WHERE FlightDate IS NOT NULL GROUP BY FlightDate)
SELECT CAST(weekofyear(FlightDate) AS INT) AS WeekOfYear, """ + ", ".join(
    r6(f"avg(CASE WHEN substring(dayname(FlightDate), 1, 3) = '{s}' THEN v END)", s) for s in R.WEEKDAY_SHORT)
    + " FROM d GROUP BY weekofyear(FlightDate)").replace("\n, d AS", ", d AS", 1))
def calendar_pivot(spark, sf_dir):
    return R.calendar_pivot(A.daily_delays(features(spark, sf_dir)))


_AIR = f"""a AS (SELECT Airline, avg(ArrDelayMinutes) AS avg_arr_delay, avg(IsArrDelayed) AS arr_delay_rate,
                 avg(Cancelled) AS cancel_rate, count(*) AS total_flights
          FROM features WHERE Airline IS NOT NULL GROUP BY Airline HAVING count(*) >= {{m}})"""
_AIR_COLS = f"Airline, {r6('avg_arr_delay', 'avg_arr_delay')}, {r6('cancel_rate', 'cancel_rate')}, total_flights"


@register("airline_topk", q(", " + _AIR.format(m=EXPLORE_AIRLINE_MIN) + " " + " UNION ALL ".join(
    _rank_sql("a", _AIR_COLS, f"{m} DESC NULLS LAST, Airline", 15, m) for m in ("avg_arr_delay", "cancel_rate"))))
def airline_topk(spark, sf_dir):
    return R.airline_rankings(A.airline_performance(features(spark, sf_dir), min_flights=EXPLORE_AIRLINE_MIN), 15)


_AIR_COLS2 = (f"Airline, {r6('avg_arr_delay', 'avg_arr_delay')}, {r6('arr_delay_rate', 'arr_delay_rate')}, "
              f"{r6('cancel_rate', 'cancel_rate')}, total_flights")


@register("airline_best_worst", q(", " + _AIR.format(m=INSIGHT_AIRLINE_MIN) + " " + " UNION ALL ".join([
    _rank_sql("a", _AIR_COLS2, "avg_arr_delay DESC NULLS LAST, Airline", 10, "worst_avg_delay"),
    _rank_sql("a", _AIR_COLS2, "avg_arr_delay ASC NULLS LAST, Airline", 10, "best_avg_delay"),
    _rank_sql("a", _AIR_COLS2, "total_flights DESC, Airline", 15, "busiest")])))
def airline_best_worst(spark, sf_dir):
    return R.airline_best_worst(A.airline_performance(features(spark, sf_dir), min_flights=INSIGHT_AIRLINE_MIN))


_ROUTE = f"""r AS (SELECT Origin, Dest, concat_ws(' → ', Origin, Dest) AS Route, avg(ArrDelayMinutes) AS avg_arr_delay,
                 avg(IsArrDelayed) AS arr_delay_rate, avg(Cancelled) AS cancel_rate, count(*) AS total_flights
          FROM features WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest
          HAVING count(*) >= {EXPLORE_ROUTE_MIN})"""
_ROUTE_COLS = (f"Origin, Dest, Route, {r6('avg_arr_delay', 'avg_arr_delay')}, {r6('arr_delay_rate', 'arr_delay_rate')}, "
               f"{r6('cancel_rate', 'cancel_rate')}, total_flights")


@register("route_topk", q(", " + _ROUTE + " " + " UNION ALL ".join(
    _rank_sql("r", _ROUTE_COLS, f"{m} DESC NULLS LAST, Origin, Dest", 20, m)
    for m in ("avg_arr_delay", "arr_delay_rate", "cancel_rate"))))
def route_topk(spark, sf_dir):
    return R.route_rankings(A.route_performance(features(spark, sf_dir), min_flights=EXPLORE_ROUTE_MIN), 20)


@register("problem_routes", q(f""", {_ROUTE},
h AS (SELECT * FROM r WHERE total_flights > (SELECT quantile_cont(total_flights, 0.75) FROM r)
                        AND arr_delay_rate > (SELECT quantile_cont(arr_delay_rate, 0.75) FROM r))
SELECT Origin, Dest, Route, total_flights, {r6('arr_delay_rate', 'arr_delay_rate')}, {r6('avg_arr_delay', 'avg_arr_delay')},
       CAST(rk AS INT) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY total_flights DESC, Origin, Dest) AS rk FROM h) WHERE rk <= 10"""))
def problem_routes(spark, sf_dir):
    return R.problem_routes(A.route_performance(features(spark, sf_dir), min_flights=EXPLORE_ROUTE_MIN))


_MON = """mo AS (SELECT MonthName, avg(ArrDelayMinutes) AS avg_delay, avg(IsArrDelayed) * 100 AS delay_rate_pct,
                avg(Cancelled) * 100 AS cancel_rate_pct FROM features WHERE MonthName IS NOT NULL GROUP BY MonthName)"""
_MON_COLS = (f"MonthName, {r6('avg_delay', 'avg_delay')}, {r6('delay_rate_pct', 'delay_rate_pct')}, "
             f"{r6('cancel_rate_pct', 'cancel_rate_pct')}")


@register("month_best_worst", q(", " + _MON + " " + " UNION ALL ".join([
    _rank_sql("mo", _MON_COLS, "avg_delay DESC NULLS LAST, MonthName", 5, "worst_delay"),
    _rank_sql("mo", _MON_COLS, "avg_delay ASC NULLS LAST, MonthName", 5, "best_delay"),
    _rank_sql("mo", _MON_COLS, "cancel_rate_pct DESC NULLS LAST, MonthName", 3, "worst_cancel")])))
def month_best_worst(spark, sf_dir):
    return R.month_best_worst(R.monthly_page_stats(features(spark, sf_dir)))


_BW = (f"""pa AS (SELECT Airline, avg(IsArrDelayed) AS arr_delay_rate, avg(ArrDelayMinutes) AS avg_arr_delay,
                  count(*) AS total_flights, """
       + ", ".join(f"CAST(count_if(ArrDelayCategory = '{c}') AS DOUBLE) * 100 / count(*) AS \"{c}\""
                   for c in DELAY_CATEGORIES)
       + f""" FROM features WHERE Airline IS NOT NULL GROUP BY Airline HAVING count(*) >= {INSIGHT_AIRLINE_MIN})""")
_BW_COLS = (f"Airline, {r6('arr_delay_rate', 'arr_delay_rate')}, {r6('avg_arr_delay', 'avg_arr_delay')}, total_flights, "
            + ", ".join(r6(f'"{c}"', f'"{c}"') for c in DELAY_CATEGORIES))


@register("best_worst_categories", q(", " + _BW + " " + " UNION ALL ".join([
    _rank_sql("pa", _BW_COLS, "arr_delay_rate DESC NULLS LAST, Airline", 5, "worst", "side"),
    _rank_sql("pa", _BW_COLS, "arr_delay_rate ASC NULLS LAST, Airline", 5, "best", "side")])))
def best_worst_categories(spark, sf_dir):
    return R.best_worst_categories(features(spark, sf_dir), min_flights=INSIGHT_AIRLINE_MIN)
