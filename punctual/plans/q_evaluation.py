"""Registered evaluation queries on the deterministic (label, Score) table."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.operators import evaluation as E
from punctual.operators.filters import exclude_cancelled_diverted
from punctual.plans.catalog import features, register
from punctual.plans.sql import q, r6

DEFAULT_THRESHOLD = 0.5
HIGH_RECALL_FLOOR = 0.75
FIXED_HIGH_RECALL = 0.4   # the dashboard's hard-coded threshold, looked up in the sweep


def scored(spark, sf_dir):
    """Flights that operated, with the arrival-delay label and the score column."""
    f = exclude_cancelled_diverted(features(spark, sf_dir))
    return f.select(F.col("IsArrDelayed").alias("label"), F.col("Score").alias("score"))


_SC = ", sc AS (SELECT IsArrDelayed AS label, Score AS score FROM features WHERE Cancelled = 0 AND Diverted = 0)"


def _d(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _counts(thr_sql: str) -> str:
    return (f", t AS ({thr_sql}), cnt AS (SELECT threshold, CAST(count_if(score >= threshold AND label = 1) AS BIGINT) AS tp, "
            "CAST(count_if(score >= threshold AND label = 0) AS BIGINT) AS fp, "
            "CAST(count_if(score < threshold AND label = 1) AS BIGINT) AS fn, "
            "CAST(count_if(score < threshold AND label = 0) AS BIGINT) AS tn FROM sc, t GROUP BY threshold)")


_SWEEP_T = "SELECT CAST(round(k * 0.05, 2) AS DOUBLE) AS threshold FROM range(2, 19) r(k)"
_ONE_T = f"SELECT CAST({DEFAULT_THRESHOLD} AS DOUBLE) AS threshold"
_F1 = "2 * tp", "2 * tp + fp + fn"
_F0 = "2 * tn", "2 * tn + fn + fp"
_SWEEP_COLS = (f"{r6('threshold', 'threshold')}, {r6(_d('tp + tn', 'tp + fp + fn + tn'), 'accuracy')}, "
               f"{r6(_d('tn', 'tn + fn'), 'precision_0')}, {r6(_d('tn', 'tn + fp'), 'recall_0')}, "
               f"{r6(_d(*_F0), 'f1_0')}, {r6(_d('tp', 'tp + fp'), 'precision_1')}, "
               f"{r6(_d('tp', 'tp + fn'), 'recall_1')}, {r6(_d(*_F1), 'f1_1')}")


@register("eval_at_threshold", q(_SC + _counts(_ONE_T) + f"""
SELECT {r6('threshold', 'threshold')}, tp, fp, fn, tn, {r6(_d('tp + tn', 'tp + fp + fn + tn'), 'accuracy')},
       {r6(_d('tp', 'tp + fp'), 'precision_1')}, {r6(_d('tp', 'tp + fn'), 'recall_1')}, {r6(_d(*_F1), 'f1_1')},
       {r6(_d('fp', 'fp + tn'), 'fpr')}, {r6(_d('fn', 'fn + tp'), 'fnr')} FROM cnt"""))
def eval_at_threshold(spark, sf_dir):
    return E.eval_at_threshold(scored(spark, sf_dir), DEFAULT_THRESHOLD)


@register("confusion_matrix", q(_SC + f"""
, g AS (SELECT a AS actual, p AS predicted FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)),
c AS (SELECT label AS actual, CAST(score >= {DEFAULT_THRESHOLD} AS INT) AS predicted, count(*) AS n FROM sc GROUP BY ALL)
SELECT CAST(g.actual AS INT) AS actual, CAST(g.predicted AS INT) AS predicted, COALESCE(c.n, 0) AS count,
       {r6('COALESCE(c.n, 0) * 100.0 / sum(COALESCE(c.n, 0)) OVER ()', 'pct')}
FROM g LEFT JOIN c ON g.actual = c.actual AND g.predicted = c.predicted"""))
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(scored(spark, sf_dir), DEFAULT_THRESHOLD)


_P1, _R1, _P0, _R0 = _d("tp", "tp + fp"), _d("tp", "tp + fn"), _d("tn", "tn + fn"), _d("tn", "tn + fp")
_N = "(tp + fn + tn + fp)"


@register("classification_report", q(_SC + _counts(_ONE_T) + f"""
, m AS (SELECT *, {_P1} AS p1, {_R1} AS r1, {_d(*_F1)} AS f1, {_P0} AS p0, {_R0} AS r0, {_d(*_F0)} AS f0 FROM cnt)
SELECT '0' AS class, {r6('p0', 'precision')}, {r6('r0', 'recall')}, {r6('f0', 'f1')}, CAST(tn + fp AS BIGINT) AS support FROM m
UNION ALL SELECT '1', {r6('p1', 'precision')}, {r6('r1', 'recall')}, {r6('f1', 'f1')}, CAST(tp + fn AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, {r6(_d('tp + tn', _N), 'f1')}, CAST({_N} AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {r6('(p0 + p1) / 2', 'precision')}, {r6('(r0 + r1) / 2', 'recall')},
                 {r6('(f0 + f1) / 2', 'f1')}, CAST({_N} AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {r6(_d('p0 * (tn + fp) + p1 * (tp + fn)', _N), 'precision')},
                 {r6(_d('r0 * (tn + fp) + r1 * (tp + fn)', _N), 'recall')},
                 {r6(_d('f0 * (tn + fp) + f1 * (tp + fn)', _N), 'f1')}, CAST({_N} AS BIGINT) FROM m"""))
def classification_report(spark, sf_dir):
    return E.classification_report(scored(spark, sf_dir), DEFAULT_THRESHOLD)


@register("threshold_sweep", q(_SC + _counts(_SWEEP_T) + f" SELECT {_SWEEP_COLS} FROM cnt"))
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(scored(spark, sf_dir))


@register("operating_point", q(_SC + _counts(_SWEEP_T) + f"""
, s AS (SELECT {_SWEEP_COLS} FROM cnt),
hr AS (SELECT 'high_recall' AS rule, * FROM s
       ORDER BY recall_1 >= {HIGH_RECALL_FLOOR} DESC,
                CASE WHEN recall_1 >= {HIGH_RECALL_FLOOR} THEN f1_1 ELSE recall_1 END DESC, threshold LIMIT 1),
nr AS (SELECT 'nearest_{FIXED_HIGH_RECALL}' AS rule, * FROM s ORDER BY abs(threshold - {FIXED_HIGH_RECALL}), threshold LIMIT 1)
SELECT * FROM hr UNION ALL SELECT * FROM nr"""))
def operating_point(spark, sf_dir):
    sw = E.threshold_sweep(scored(spark, sf_dir))
    hr = E.operating_point(sw, HIGH_RECALL_FLOOR).select(F.lit("high_recall").alias("rule"), "*")
    nr = E.nearest_threshold(sw, FIXED_HIGH_RECALL).select(F.lit(f"nearest_{FIXED_HIGH_RECALL}").alias("rule"), "*")
    return hr.unionByName(nr)


_ROC = """, sc2 AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM sc
              WHERE score IS NOT NULL GROUP BY score),
c AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tps,
             CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fps FROM sc2),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc2)"""


@register("roc_curve", q(_SC + _ROC + f"""
SELECT {r6('score', 'threshold')}, {r6(_d('fps', 'N'), 'fpr')}, {r6(_d('tps', 'P'), 'tpr')}, tps, fps FROM c, tot
UNION ALL SELECT NULL, 0.0, 0.0, 0, 0"""))
def roc_curve(spark, sf_dir):
    return E.roc_curve(scored(spark, sf_dir))


@register("roc_auc", q(_SC + _ROC + f"""
SELECT {r6(_d('sum(pos * (N - fps + 0.5 * neg))', 'any_value(P) * any_value(N)'), 'roc_auc')},
       CAST(any_value(P) AS BIGINT) AS n_pos, CAST(any_value(N) AS BIGINT) AS n_neg FROM c, tot"""))
def roc_auc(spark, sf_dir):
    return E.roc_auc(scored(spark, sf_dir))


@register("eval_summary", q(_SC + _counts(_SWEEP_T) + _ROC.replace(", sc2 AS", ", sc2 AS", 1) + f"""
, s AS (SELECT {_SWEEP_COLS} FROM cnt),
hr AS (SELECT threshold FROM s ORDER BY recall_1 >= {HIGH_RECALL_FLOOR} DESC,
                CASE WHEN recall_1 >= {HIGH_RECALL_FLOOR} THEN f1_1 ELSE recall_1 END DESC, threshold LIMIT 1),
d AS (SELECT * FROM s WHERE threshold = {DEFAULT_THRESHOLD}),
a AS (SELECT {_d('sum(pos * (N - fps + 0.5 * neg))', 'any_value(P) * any_value(N)')} AS auc,
             any_value(P) AS P, any_value(N) AS N FROM c, tot)
SELECT CAST(a.P + a.N AS BIGINT) AS n_test, {r6('a.P / (a.P + a.N)', 'delay_rate_test')},
       {r6('d.accuracy', 'accuracy_default_thr')}, {r6('a.auc', 'roc_auc')},
       {r6(str(DEFAULT_THRESHOLD), 'default_threshold')}, {r6('hr.threshold', 'high_recall_threshold')}
FROM a, d, hr"""))
def eval_summary(spark, sf_dir):
    sc = scored(spark, sf_dir)
    sw = E.threshold_sweep(sc)
    auc = E.roc_auc(sc)
    d = sw.filter(F.col("threshold") == DEFAULT_THRESHOLD).select("accuracy").first()[0]   # sweep: 17 rows
    hr = E.operating_point(sw, HIGH_RECALL_FLOOR).select("threshold").first()[0]
    return auc.select((F.col("n_pos") + F.col("n_neg")).alias("n_test"),
                      (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("delay_rate_test"),
                      F.lit(d).cast("double").alias("accuracy_default_thr"), "roc_auc",
                      F.lit(DEFAULT_THRESHOLD).alias("default_threshold"),
                      F.lit(hr).cast("double").alias("high_recall_threshold"))


@register("risk_bands", q(_SC + f"""
, b AS (SELECT *, avg(label) OVER () * 100 AS baseline_pct FROM sc)
SELECT CASE WHEN score * 100 < 20 THEN 'Low' WHEN score * 100 < 40 THEN 'Medium' ELSE 'High' END AS risk_level,
       CASE WHEN score >= {DEFAULT_THRESHOLD} THEN 'Delayed' ELSE 'On-Time' END AS predicted_label,
       count(*) AS flights, {r6('avg(score * 100)', 'avg_risk_pct')},
       {r6('avg(score * 100 - baseline_pct)', 'avg_delta_to_baseline')}, {r6('avg(label)', 'actual_delay_rate')}
FROM b GROUP BY 1, 2"""))
def risk_bands(spark, sf_dir):
    """Risk band and decision label per scored flight, summarised;
    the baseline is the observed delay rate (not a hard-coded constant)."""
    from punctual.functions.features import outcome_label, risk_level
    sc = scored(spark, sf_dir)
    base = sc.agg(F.avg("label") * 100).scalar()
    return (sc.select(risk_level("score").alias("risk_level"),
                      outcome_label((F.col("score") >= DEFAULT_THRESHOLD).cast("int")).alias("predicted_label"),
                      (F.col("score") * 100).alias("risk_pct"), (F.col("score") * 100 - base).alias("delta"), "label")
              .groupBy("risk_level", "predicted_label")
              .agg(F.count(F.lit(1)).alias("flights"), F.avg("risk_pct").alias("avg_risk_pct"),
                   F.avg("delta").alias("avg_delta_to_baseline"), F.avg("label").alias("actual_delay_rate")))
