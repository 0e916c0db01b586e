"""Evaluation fixture of FIXTURES §4.3 and cross-checks with Spark ML."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from punctual.operators import evaluation as E

PAIRS = [(1, .9), (0, .8), (1, .7), (0, .4), (1, .4), (0, .1)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(PAIRS, "label int, score double")


def test_auc(scored):
    assert abs(E.roc_auc(scored).first().roc_auc - 0.722222) < 1e-6


def test_auc_matches_spark_ml(spark):
    df = spark.range(2000).selectExpr("CAST(id % 3 = 0 AS INT) AS label",
                                      "round((id * 7919 % 1000) / 1000.0 + CAST(id % 3 = 0 AS INT) * 0.2, 2) AS score")
    ours = E.roc_auc(df).first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert abs(ours - ev.evaluate(df.selectExpr("CAST(label AS DOUBLE) label", "CAST(score AS DOUBLE) score"))) < 1e-9


def test_threshold_points(scored):
    c = {r.threshold: r for r in E.threshold_counts(scored, [0.5, 0.4, 0.95]).collect()}
    assert (c[0.5].tp, c[0.5].fp, c[0.5].fn, c[0.5].tn) == (2, 1, 1, 2)
    assert (c[0.4].tp, c[0.4].fp, c[0.4].fn, c[0.4].tn) == (3, 2, 0, 1)
    m = {r.threshold: r for r in E.sweep_metrics(E.threshold_counts(scored, [0.4, 0.5, 0.95])).collect()}
    assert abs(m[0.5].accuracy - 4 / 6) < 1e-12 and abs(m[0.5].f1_1 - 2 / 3) < 1e-12
    assert abs(m[0.4].precision_1 - 0.6) < 1e-12 and m[0.4].recall_1 == 1.0 and abs(m[0.4].f1_1 - 0.75) < 1e-12
    assert m[0.95].precision_1 == 0.0  # zero division -> 0, not null
    r = E.eval_at_threshold(scored, 0.5).first()
    assert abs(r.fpr - 1 / 3) < 1e-12 and abs(r.fnr - 1 / 3) < 1e-12


def test_sweep_recall_monotone(spark):
    df = spark.range(3000).selectExpr("CAST(id % 4 = 0 AS INT) AS label", "(id * 37 % 1000) / 1000.0 AS score")
    rec = [r.recall_1 for r in E.threshold_sweep(df).collect()]
    assert all(a >= b for a, b in zip(rec, rec[1:]))


def test_roc_curve_area(spark):
    df = spark.range(1500).selectExpr("CAST(id % 5 < 2 AS INT) AS label",
                                      "round(((id * 7907) % 1000) / 1000.0 + CAST(id % 5 < 2 AS INT) * 0.15, 3) AS score")
    pts = sorted((r.fpr, r.tpr) for r in E.roc_curve(df).collect())
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
    assert abs(area - E.roc_auc(df).first().roc_auc) < 1e-9


def test_operating_point_prefers_recall_floor(spark):
    rows = [(0.1, 0.9, 0.3), (0.2, 0.8, 0.5), (0.3, 0.7, 0.6)]
    sw = spark.createDataFrame(rows, "threshold double, recall_1 double, f1_1 double")
    assert E.operating_point(sw, 0.75).first().threshold == 0.2
    assert E.operating_point(sw, 0.95).first().threshold == 0.1   # none qualifies -> best recall
    assert E.nearest_threshold(sw, 0.26).first().threshold == 0.3


def test_roc_bucketed_prefix_sums_match_single_bucket(spark):
    df = spark.range(4000).selectExpr("CAST(id % 3 = 0 AS INT) AS label",
                                      "round(pow((id * 7919 % 1000) / 1000.0, 3), 4) AS score")
    one, P, N = E.roc_table(df, buckets=1)
    many, P2, N2 = E.roc_table(df, buckets=37)   # skewed scores, quantile buckets
    a = {r.score: (r.tps, r.fps) for r in one.collect()}
    b = {r.score: (r.tps, r.fps) for r in many.collect()}
    assert (P, N) == (P2, N2) and a == b
