"""Independent SQL (DuckDB dialect) for every relational query.

These strings are the correctness oracle: each one recomputes a query from
the raw star-schema tables without any of this package's code.  ``{div}`` in
the adapter is integer division (``//`` in DuckDB).
"""

from __future__ import annotations

import math

ADAPTER = """
WITH b AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS FlightKey,
         CAST(l_shipdate AS DATE) AS FlightDate, p_brand AS Airline,
         sn.n_name AS Origin, cn.n_name AS Dest,
         CAST(10000 + s_nationkey AS INT) AS OriginAirportID, CAST(10000 + c_nationkey AS INT) AS DestAirportID,
         l_orderkey AS FlightNumber, s_nationkey,
         (l_orderkey*31 + l_linenumber*17 + l_partkey*7) % 1000 AS h,
         (l_orderkey*13 + l_linenumber*101) % 1440 AS dep_min,
         CAST(100 + (s_nationkey*977 + c_nationkey*613) % 2900 AS INT) AS Distance,
         CAST(l_quantity AS INT) AS TaxiOut, CAST(l_linenumber*2 AS INT) AS TaxiIn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey),
c AS (
  SELECT *, (dep_min + 40 + Distance // 8) % 1440 AS arr_min,
         CASE WHEN h % 50 = 0 THEN 1 ELSE 0 END AS Cancelled,
         CASE WHEN h % 97 = 0 THEN 1 ELSE 0 END AS Diverted,
         (h*7 + (dep_min // 60)*100 + s_nationkey*40) // 10 AS sc
  FROM b),
e AS (
  SELECT *, CASE WHEN sc < 150 THEN -1 - h % 20 WHEN sc < 400 THEN 0 WHEN sc < 720 THEN 1 + h % 15
                 WHEN sc < 880 THEN 16 + h % 45 WHEN sc < 960 THEN 61 + h % 120 ELSE 181 + h % 300 END AS dly
  FROM c)
SELECT FlightKey, FlightDate, Airline, Origin, Dest, OriginAirportID, DestAirportID, FlightNumber,
       CAST((dep_min // 60)*100 + dep_min % 60 AS INT) AS CRSDepTime,
       CAST((arr_min // 60)*100 + arr_min % 60 AS INT) AS CRSArrTime,
       Distance, TaxiOut, TaxiIn, Cancelled, Diverted,
       CAST(CASE WHEN Cancelled = 1 THEN NULL ELSE dly + h % 7 - 3 END AS DOUBLE) AS DepDelayMinutes,
       CAST(CASE WHEN Cancelled = 1 OR Diverted = 1 THEN NULL ELSE dly END AS DOUBLE) AS ArrDelayMinutes,
       CAST(CASE WHEN Cancelled = 1 THEN NULL ELSE ((dep_min + greatest(dly, 0)) % 1440) // 60 * 100 + ((dep_min + greatest(dly, 0)) % 1440) % 60 END AS INT) AS DepTime,
       CAST(CASE WHEN Cancelled = 1 OR Diverted = 1 THEN NULL ELSE ((arr_min + greatest(dly, 0)) % 1440) // 60 * 100 + ((arr_min + greatest(dly, 0)) % 1440) % 60 END AS INT) AS ArrTime,
       CAST(least(999, ((sc*6) // 10) + (h*389) % 400) AS DOUBLE) / 1000 AS Score
FROM e
"""


def _cat(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN 'Unknown' WHEN {col} < 0 THEN 'Early' "
            f"WHEN {col} = 0 THEN 'On Time' WHEN {col} <= 15 THEN 'Small Delay' "
            f"WHEN {col} <= 60 THEN 'Moderate Delay' WHEN {col} <= 180 THEN 'Large Delay' "
            f"ELSE 'Very Large Delay' END")


FEATURES = f"""
SELECT *,
       CAST(year(FlightDate) AS INT) AS Year, CAST(month(FlightDate) AS INT) AS Month,
       monthname(FlightDate) AS MonthName, CAST(isodow(FlightDate) - 1 AS INT) AS DayOfWeek,
       dayname(FlightDate) AS DayOfWeekName, CAST(weekofyear(FlightDate) AS INT) AS WeekOfYear,
       CAST(floor(CRSDepTime / 100) AS INT) AS DepHour,
       CASE WHEN CRSDepTime // 100 BETWEEN 0 AND 6 THEN 'Night (0-6)'
            WHEN CRSDepTime // 100 > 6 AND CRSDepTime // 100 <= 12 THEN 'Morning (6-12)'
            WHEN CRSDepTime // 100 > 12 AND CRSDepTime // 100 <= 18 THEN 'Afternoon (12-18)'
            WHEN CRSDepTime // 100 > 18 AND CRSDepTime // 100 <= 24 THEN 'Evening (18-24)' END AS DepTimeOfDay,
       {_cat('ArrDelayMinutes')} AS ArrDelayCategory,
       CASE WHEN ArrDelayMinutes > 15 THEN 1 ELSE 0 END AS IsArrDelayed,
       {_cat('DepDelayMinutes')} AS DepDelayCategory,
       CASE WHEN DepDelayMinutes > 15 THEN 1 ELSE 0 END AS IsDepDelayed
FROM flights
"""


def q(body: str) -> str:
    """Wrap a query body with the flights + features CTEs."""
    return f"WITH flights AS ({ADAPTER}), features AS ({FEATURES}) {body}"


def r6(expr: str, alias: str) -> str:
    """Round a double to 6 places (the Spark side rounds every double column)."""
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {alias}"


def cut_sql(col: str, edges: list[float], labels: list[str]) -> str:
    """Right-closed binning (a, b] as a CASE expression."""
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{col} > {lo}" + ("" if math.isinf(hi) else f" AND {col} <= {hi}")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


_MIN = "(({c} // 100) * 60 + {c} % 100)"


def duration_sql(a: str, b: str) -> str:
    """Minutes from HHMM ``a`` to HHMM ``b``, +1440 across midnight."""
    d = f"({_MIN.format(c=b)} - {_MIN.format(c=a)})"
    return f"CAST(CASE WHEN {d} < 0 THEN {d} + 1440 ELSE {d} END AS INT)"
