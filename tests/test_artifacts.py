import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from punctual.session import fresh_path
from punctual.sources import artifacts as A


def test_versions_are_published_whole(spark):
    base = fresh_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        A.load(spark, base)
    one = A.publish(spark, base, {"a": spark.range(3), "b": spark.range(2)}, {"n": 1})
    two = A.publish(spark, base, {"a": spark.range(5), "b": spark.range(2)}, {"n": 2})
    # a build that stopped before its manifest is never read
    spark.range(9).write.parquet(f"{base}/99999999999999999999-half/a")
    assert A.versions(spark, base) == [one, two]
    tables, about = A.load(spark, base)
    assert about == {"n": 2} and tables["a"].count() == 5
    assert A.load(spark, base, one)[1] == {"n": 1}


def test_changed_tables_are_refused(spark):
    base = fresh_path(spark, "store")
    v = A.publish(spark, base, {"a": spark.range(3), "b": spark.range(2)}, {})
    spark.range(1).write.mode("append").parquet(f"{base}/{v}/a")
    with pytest.raises(ValueError):
        A.load(spark, base)
    w = A.publish(spark, base, {"a": spark.range(3)}, {})
    spark.range(3).select(F.col("id").alias("other")).write.mode("overwrite").parquet(f"{base}/{w}/a")
    with pytest.raises(ValueError):
        A.load(spark, base)


def test_the_whole_build_comes_back(spark):
    from punctual.plans.catalog import QUERIES
    rows = QUERIES["model_roundtrip"](spark, SF_SMALL).collect()
    assert {r.artifact for r in rows} == {"model", "imputer_scaler", "label_encoders", "metrics", "selection", "surrogate",
                                          "attributions", "scores"}
    assert all(r.rows == r.rows_loaded > 0 and r.rows_different == 0 for r in rows)


def test_record_holds_the_curve(spark):
    from punctual.operators import evaluation as E
    from punctual.plans import q_modeling as Q
    scores = Q.model_scores(spark, SF_SMALL)
    r = Q.model_summary(spark, SF_SMALL).first()
    assert r.default_threshold == 0.5 and len(r.fpr) == len(r.tpr) == len(r.roc_thresholds) == 1002
    assert (r.fpr[0], r.tpr[0], r.fpr[-1], r.tpr[-1]) == (0.0, 0.0, 1.0, 1.0)
    local = [(x.label, x.score) for x in scores.collect()]
    pos = sum(x[0] == 1 for x in local)
    for i in (1, 300, 500, 777, 1001):
        t = r.roc_thresholds[i]
        assert abs(r.tpr[i] - sum(y == 1 and s >= t for y, s in local) / pos) < 1e-12
        assert abs(r.fpr[i] - sum(y == 0 and s >= t for y, s in local) / (len(local) - pos)) < 1e-12


def test_surrogate_on_predictions(spark):
    from punctual.plans.catalog import QUERIES
    rows = QUERIES["surrogate_on_predictions"](spark, SF_SMALL).collect()
    assert 0.6 < rows[0].agreement <= 1 and all(r.depth <= 3 for r in rows)
