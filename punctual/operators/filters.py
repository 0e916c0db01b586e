"""Filter operators.

Filters are written on raw columns wherever possible (FlightDate, Airline,
Distance) so Catalyst pushes them into the parquet scan; derived-column
filters (weekday name, time of day) stay in the same codegen'd stage.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explore_predicate(date_range: tuple | None = None, airlines: list[str] | None = None,
                      weekdays: list[str] | None = None, times_of_day: list[str] | None = None,
                      distance_range: tuple | None = None) -> Column:
    """P-1..P-3: conjunctive dashboard filter.

    * ``date_range`` inclusive; a one-element range is an open-ended lower
      bound (the reference silently disabled filtering in that case).
    * Empty / ``None`` IN-lists mean *no filter*.
    * Distance range is inclusive and excludes null distances.
    """
    conds: list[Column] = []
    if date_range:
        # the year bounds say nothing new, but Year is the partition column: they prune whole folders
        lo = _as_date(date_range[0])
        conds += [F.col("FlightDate") >= F.lit(lo), F.col("Year") >= F.lit(lo.year)]
        if len(date_range) > 1 and date_range[1] is not None:
            hi = _as_date(date_range[1])
            conds += [F.col("FlightDate") <= F.lit(hi), F.col("Year") <= F.lit(hi.year)]
    if airlines:
        conds.append(F.col("Airline").isin(list(airlines)))
    if weekdays:
        conds.append(F.col("DayOfWeekName").isin(list(weekdays)))
    if times_of_day:
        conds.append(F.col("DepTimeOfDay").isin(list(times_of_day)))
    if distance_range:
        conds.append(F.col("Distance").between(distance_range[0], distance_range[1]))
    pred = F.lit(True)
    for c in conds:
        pred = pred & c
    return pred


def _as_date(v):
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v if isinstance(v, _dt.date) and not isinstance(v, _dt.datetime) else v.date()
    return _dt.date.fromisoformat(str(v))


def apply_filter(feat: DataFrame, pred: Column) -> DataFrame:
    """Apply a predicate built by ``explore_predicate``."""
    return feat.filter(pred)


def filtered_kpis(feat: DataFrame, pred: Column) -> DataFrame:
    """P-4 + A1 on the filtered rows.

    The filter reaches the scan (pruned folders, pushed predicates); the share
    of rows kept takes the total from a count that reads no column.  An empty
    selection yields null rates, not an error.
    """
    arr = F.col("ArrDelayMinutes")
    total = feat.agg(F.count(F.lit(1))).scalar()
    kept = F.count(F.lit(1))
    return apply_filter(feat, pred).agg(
        kept.alias("kept_flights"),
        F.avg(arr).alias("avg_arr_delay"),
        F.avg(F.col("IsArrDelayed").cast("double")).alias("arr_delay_rate"),
        F.avg(F.col("Cancelled").cast("double")).alias("cancel_rate"),
        F.avg(F.col("Diverted").cast("double")).alias("divert_rate"),
        F.try_divide(F.count_if(F.coalesce(arr <= 15, F.lit(False))), kept).alias("on_time_rate"),
    ).withColumn("kept_share", F.col("kept_flights") / total)


def exclude_cancelled_diverted(df: DataFrame) -> DataFrame:
    """P-5: keep flights that were neither cancelled nor diverted."""
    for c in ("Cancelled", "Diverted"):
        if c in df.columns:
            df = df.filter(F.col(c).cast("int") == 0)
    return df


def above_quantiles(agg: DataFrame, cols: list[str], q: float = 0.75) -> DataFrame:
    """P-15: keep rows strictly above the q-quantile of every column in ``cols``.

    Each quantile is an exact scalar subquery (one aggregated value, planned
    as a ``Subquery`` and inlined into the filter) -- no join at all.
    """
    out = agg
    for c in cols:
        out = out.filter(F.col(c) > agg.agg(F.percentile(F.col(c), q)).scalar())
    return out
