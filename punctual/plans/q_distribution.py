"""Registered distribution / binning / correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import features as fx
from punctual.operators import distribution as D
from punctual.plans.catalog import features, register
from punctual.plans.sql import cut_sql, duration_sql, q, r6
from punctual.schema import (DISTANCE_EDGES_EDA, DISTANCE_EDGES_INSIGHT, DISTANCE_LABELS, DURATION_EDGES,
                             DURATION_LABELS)

HIST_BINS = 100
SPLIT_HIST_BINS = 50
CORR_FEATURES = ["ArrDelayMinutes", "DepDelayMinutes", "TaxiOut", "TaxiIn", "ScheduledDuration", "ActualDuration",
                 "DepHour", "MonthNum", "DayOfWeekNum", "Year", "OriginAirportID", "DestAirportID",
                 "CRSDepTime", "CRSArrTime", "Distance"]
CORR_PAIRS = [("DepDelayMinutes", "ArrDelayMinutes"), ("Distance", "ArrDelayMinutes"),
              ("Distance", "DepDelayMinutes"), ("DayOfWeek", "ArrDelayMinutes"), ("Month", "ArrDelayMinutes"),
              ("Year", "ArrDelayMinutes"), ("DepHour", "ArrDelayMinutes"), ("TaxiOut", "ArrDelayMinutes")]
TREND_X = ["DepDelayMinutes", "Distance", "DepHour", "TaxiOut"]
TARGET = "ArrDelayMinutes"


def corr_table(spark, sf_dir):
    """Feature table plus the notebook's derived numeric columns."""
    return features(spark, sf_dir).withColumns({
        "ScheduledDuration": fx.duration_minutes("CRSDepTime", "CRSArrTime"),
        "ActualDuration": fx.duration_minutes("DepTime", "ArrTime"),
        "MonthNum": F.col("Month"), "DayOfWeekNum": F.col("DayOfWeek")})


CORR_SQL = (f"ct AS (SELECT *, {duration_sql('CRSDepTime', 'CRSArrTime')} AS ScheduledDuration, "
            f"{duration_sql('DepTime', 'ArrTime')} AS ActualDuration, Month AS MonthNum, "
            f"DayOfWeek AS DayOfWeekNum FROM features)")


# ---------------------------------------------------------------------------
# D1-D3
# ---------------------------------------------------------------------------
def _hist_sql(series_case: str, bins: int) -> str:
    return f""", x AS (SELECT {series_case} AS series, CAST(ArrDelayMinutes AS DOUBLE) AS x FROM features
             WHERE ArrDelayMinutes IS NOT NULL),
x2 AS (SELECT * FROM x WHERE series IS NOT NULL),
r AS (SELECT series, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins} AS w FROM x2 GROUP BY series),
c AS (SELECT x2.series, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - lo) / w), {bins - 1}) END AS INT) AS bin,
             count(*) AS cnt FROM x2 JOIN r ON x2.series = r.series GROUP BY ALL),
g AS (SELECT r.*, CAST(b.range AS INT) AS bin FROM r, range({bins}) b)
SELECT g.series, g.bin, {r6('lo + g.bin * w', 'bin_lo')}, {r6('lo + (g.bin + 1) * w', 'bin_hi')},
       COALESCE(cnt, 0) AS count
FROM g LEFT JOIN c ON g.series = c.series AND g.bin = c.bin"""


@register("delay_histogram", q(_hist_sql("'all'", HIST_BINS)))
def delay_histogram(spark, sf_dir):
    return D.histogram(features(spark, sf_dir), TARGET, HIST_BINS)


@register("delay_histogram_split", q(_hist_sql(
    "CASE WHEN ArrDelayMinutes <= 15 THEN 'on_time' WHEN ArrDelayMinutes > 15 THEN 'delayed' END", SPLIT_HIST_BINS)))
def delay_histogram_split(spark, sf_dir):
    a = F.col(TARGET)
    return D.histogram(features(spark, sf_dir), TARGET, SPLIT_HIST_BINS,
                       series={"on_time": a <= 15, "delayed": a > 15})


@register("delay_boxplot", q(f"""
, x AS (SELECT CAST(ArrDelayMinutes AS DOUBLE) AS x FROM features WHERE ArrDelayMinutes IS NOT NULL),
qq AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS q3 FROM x)
SELECT count(*) AS n, {r6('min(x)', '"min"')}, {r6('any_value(q1)', 'q1')}, {r6('any_value(md)', 'median')},
       {r6('any_value(q3)', 'q3')}, {r6('any_value(q3 - q1)', 'iqr')},
       {r6('min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END)', 'lower_whisker')},
       {r6('max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END)', 'upper_whisker')},
       CAST(count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers, {r6('max(x)', '"max"')}
FROM x, qq"""))
def delay_boxplot(spark, sf_dir):
    return D.box_stats(features(spark, sf_dir), TARGET)


# ---------------------------------------------------------------------------
# F18-F20 bins, A21-A22
# ---------------------------------------------------------------------------
def _dim(labels) -> str:
    return "(VALUES " + ", ".join(f"('{lab}', {i})" for i, lab in enumerate(labels)) + ") AS dim(bin, o)"


def _eda_bins_sql(col_sql: str, edges, labels, src: str = "features") -> str:
    return f""", d AS (SELECT {cut_sql('v', edges, labels)} AS bin, ArrDelayMinutes FROM
             (SELECT *, {col_sql} AS v FROM {src})
             WHERE v IS NOT NULL AND ArrDelayMinutes IS NOT NULL AND DepDelayMinutes IS NOT NULL),
a AS (SELECT bin, avg(ArrDelayMinutes) AS m, stddev_samp(ArrDelayMinutes) AS sd, count(*) AS n,
             avg(CASE WHEN ArrDelayMinutes > 15 THEN 1.0 ELSE 0.0 END) AS rt FROM d WHERE bin IS NOT NULL GROUP BY bin)
SELECT dim.bin, {r6('a.m', 'avg_arr_delay')}, {r6('a.sd', 'std_arr_delay')}, COALESCE(a.n, 0) AS flights,
       {r6('CASE WHEN a.n >= 100 THEN a.rt END', 'delay_rate')}
FROM {_dim(labels)} LEFT JOIN a ON a.bin = dim.bin"""


@register("distance_bins_eda", q(_eda_bins_sql("Distance", DISTANCE_EDGES_EDA, DISTANCE_LABELS)))
def distance_bins_eda(spark, sf_dir):
    return D.binned_delay_eda(features(spark, sf_dir), "Distance", DISTANCE_EDGES_EDA, DISTANCE_LABELS)


@register("duration_bins", q(_eda_bins_sql(duration_sql("CRSDepTime", "CRSArrTime"), DURATION_EDGES,
                                           DURATION_LABELS)))
def duration_bins(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("ScheduledDuration", fx.duration_minutes("CRSDepTime", "CRSArrTime"))
    return D.binned_delay_eda(f, "ScheduledDuration", DURATION_EDGES, DURATION_LABELS)


@register("distance_bins_insight", q(f"""
, a AS (SELECT {cut_sql('Distance', DISTANCE_EDGES_INSIGHT, DISTANCE_LABELS)} AS bin, avg(ArrDelayMinutes) AS m,
               avg(IsArrDelayed) * 100 AS rt, count(*) AS n FROM features GROUP BY 1)
SELECT dim.bin, {r6('a.m', 'avg_delay')}, {r6('a.rt', 'delay_rate_pct')}, COALESCE(a.n, 0) AS flights
FROM {_dim(DISTANCE_LABELS)} LEFT JOIN a ON a.bin = dim.bin"""))
def distance_bins_insight(spark, sf_dir):
    return D.binned_delay_insight(features(spark, sf_dir), "Distance", DISTANCE_EDGES_INSIGHT, DISTANCE_LABELS)


# ---------------------------------------------------------------------------
# C1-C7
# ---------------------------------------------------------------------------
@register("corr_pairs", q(" UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n_pairs, "
    f"{r6(f'corr({a}, {b})', 'pearson')} FROM features" for a, b in CORR_PAIRS)))
def corr_pairs(spark, sf_dir):
    return D.corr_pairs(features(spark, sf_dir), CORR_PAIRS)


def _matrix_sql(src: str, cols: list[str]) -> str:
    n = len(cols)
    aggs = ", ".join(f"corr({cols[i]}, {cols[j]}) AS c_{i}_{j}" for i in range(n) for j in range(i + 1, n))
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = "1.0" if i == j else f"c_{min(i, j)}_{max(i, j)}"
            parts.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {r6(v, 'r')} FROM agg")
    return f"agg AS (SELECT {aggs} FROM {src}) " + " UNION ALL ".join(parts)


_NN = " AND ".join(f"{c} IS NOT NULL" for c in CORR_FEATURES)
_PEARSON_SRC = f"cc AS (SELECT {', '.join(CORR_FEATURES)} FROM ct WHERE {_NN})"
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                   for c in CORR_FEATURES)
_SPEARMAN_SRC = f"{_PEARSON_SRC}, rk AS (SELECT {_RANKS} FROM cc)"


@register("corr_matrix_pearson", q(f", {CORR_SQL}, {_PEARSON_SRC}, {_matrix_sql('cc', CORR_FEATURES)}"))
def corr_matrix_pearson(spark, sf_dir):
    return D.corr_matrix(corr_table(spark, sf_dir), CORR_FEATURES)


@register("corr_matrix_spearman", q(f", {CORR_SQL}, {_SPEARMAN_SRC}, {_matrix_sql('rk', CORR_FEATURES)}"))
def corr_matrix_spearman(spark, sf_dir):
    return D.spearman_matrix(corr_table(spark, sf_dir), CORR_FEATURES)


def _target_sql(src: str) -> str:
    aggs = ", ".join(f"corr({c}, {TARGET}) AS {c}" for c in CORR_FEATURES if c != TARGET)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS r FROM agg" for c in CORR_FEATURES if c != TARGET)
    return f"agg AS (SELECT {aggs} FROM {src}), t AS ({rows})"


@register("corr_with_target", q(f", {CORR_SQL}, {_PEARSON_SRC}, {_target_sql('cc')}" + f"""
SELECT feature, {r6('r', 'r')}, {r6('abs(r)', 'abs_r')},
       CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction, CAST(rk AS INT) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature) AS rk FROM t) WHERE rk <= 10"""))
def corr_with_target(spark, sf_dir):
    return D.corr_with_target(D.corr_matrix(corr_table(spark, sf_dir), CORR_FEATURES, against=TARGET), TARGET)


@register("corr_compare", q(f", {CORR_SQL}, {_SPEARMAN_SRC}, " + f"""
pa AS (SELECT {', '.join(f"corr({c}, {TARGET}) AS {c}" for c in CORR_FEATURES if c != TARGET)} FROM cc),
sa AS (SELECT {', '.join(f"corr({c}, {TARGET}) AS {c}" for c in CORR_FEATURES if c != TARGET)} FROM rk)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'abs(pa.{c})', 'pearson_abs')}, {r6(f'abs(sa.{c})', 'spearman_abs')} FROM pa, sa"
    for c in CORR_FEATURES if c != TARGET)
    + f" UNION ALL SELECT '{TARGET}' AS feature, 1.0 AS pearson_abs, 1.0 AS spearman_abs"))
def corr_compare(spark, sf_dir):
    t = corr_table(spark, sf_dir)
    return D.corr_compare(D.corr_matrix(t, CORR_FEATURES, against=TARGET), D.spearman_matrix(t, CORR_FEATURES, TARGET), TARGET)


@register("airline_indicator_corr", q(f"""
, p AS (SELECT Airline, count(*) AS n_all, CAST(count(ArrDelayMinutes) AS DOUBLE) AS n_a,
               sum(ArrDelayMinutes) AS s_a, sum(ArrDelayMinutes * ArrDelayMinutes) AS q_a
        FROM features GROUP BY Airline),
g AS (SELECT sum(n_a) AS n, sum(s_a) AS s, sum(q_a) AS qq FROM p),
c AS (SELECT Airline, n_all AS flights, (n * s_a - n_a * s) / sqrt(n_a * (n - n_a) * (n * qq - s * s)) AS corr
      FROM p, g WHERE Airline IS NOT NULL AND n_all > 100)
SELECT Airline, flights, {r6('corr', 'corr')}, CAST(rk AS INT) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY corr DESC NULLS LAST, Airline) AS rk FROM c) WHERE rk <= 15"""))
def airline_indicator_corr(spark, sf_dir):
    return D.indicator_corr(features(spark, sf_dir), "Airline", TARGET)


@register("linear_trend", q(" UNION ALL ".join(
    f"SELECT '{x}' AS x, '{TARGET}' AS y, CAST(regr_count({TARGET}, {x}) AS BIGINT) AS n, "
    f"{r6(f'regr_slope({TARGET}, {x})', 'slope')}, {r6(f'regr_intercept({TARGET}, {x})', 'intercept')} FROM features"
    for x in TREND_X)))
def linear_trend(spark, sf_dir):
    return D.linear_trend(features(spark, sf_dir), TARGET, TREND_X)
