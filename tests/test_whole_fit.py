"""Models are fitted on every row of the balanced train set, however many there are."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF_SMALL
from punctual.operators import modeling as M
from punctual.operators import trees as TR
from punctual.plans import pipeline as PL
from punctual.plans import q_modeling as Q
from punctual.session import scratch_path

ROWS = 30_000
ONE_TREE = [{"name": "one", "type": "rf", "numTrees": 1, "maxDepth": 4, "minSplit": 10, "minInstancesPerNode": 5}]


def model_rows(spark, n):
    """A balanced train set of ``n`` rows."""
    hour, month, day = F.expr("cast(id % 24 as int)"), F.expr("cast(id % 12 + 1 as int)"), F.expr("cast(id % 7 + 1 as int)")
    return spark.range(n).select(
        F.expr("cast(hash(id) % 10 > hour(timestamp_seconds(id * 3600)) % 10 - 5 as int)").alias("IsArrDelayed"),
        F.col("id").cast("string").alias("FlightKey"), F.expr("date_add(date'2020-01-01', cast(id % 365 as int))").alias("FlightDate"),
        (hour * 100 + (F.col("id") % 60).cast("int")).alias("CRSDepTime"), F.lit(10).alias("TaxiOut"),
        F.concat(F.lit("A"), F.col("id") % 5).alias("Airline"), F.concat(F.lit("O"), F.col("id") % 9).alias("Origin"),
        F.concat(F.lit("D"), F.col("id") % 8).alias("Dest"), (F.col("id") % 2500).cast("int").alias("Distance"),
        ((F.col("id") % 2500) / 250).cast("int").alias("DistanceGroup"), F.lit(2020).alias("Year"), month.alias("Month"),
        F.concat(F.lit("M"), month).alias("MonthName"), day.alias("DayOfWeek"), F.concat(F.lit("W"), day).alias("DayOfWeekName"),
        (F.col("id") % 28 + 1).cast("int").alias("DayofMonth"), F.ceil(month / 3).cast("int").alias("Quarter"), hour.alias("DepHour"),
        F.concat(F.lit("T"), F.floor(hour / 6)).alias("DepTimeOfDay"), F.concat(F.lit("B"), hour).alias("DepTimeBlk"))


@pytest.fixture
def many_rows(spark, monkeypatch):
    """The registered queries over ``ROWS`` rows and a grid of one tree."""
    rows = model_rows(spark, ROWS).checkpoint()
    monkeypatch.setattr(PL, "balanced_train", lambda *a, **b: rows)
    monkeypatch.setattr(PL, "_CACHE", {})
    monkeypatch.setattr(Q, "_MODELS", {})
    monkeypatch.setattr(Q, "GRID", ONE_TREE)
    return rows


def test_ensembles_see_every_row(spark, many_rows):
    t = Q.trained(spark, SF_SMALL)
    (tree,) = [tree for g in t.model.groups() for tree in g]
    # the draw has as many rows as the train set, up to five standard deviations of Poisson(1) counts
    assert abs(tree["cover"][0] - ROWS) < 5 * ROWS ** 0.5


def test_surrogate_tree_sees_every_row(spark, many_rows):
    assert sum(r.samples for r in Q.surrogate_tree(spark, SF_SMALL).collect()) == ROWS
    assert sum(r.samples for r in Q.surrogate_on_predictions(spark, SF_SMALL).collect()) == ROWS


def test_surrogate_thresholds_come_from_every_row(spark):
    """Beyond 256^2 rows there is still a threshold between any two values, also where each comes once."""
    rows = spark.range(90_000).selectExpr("if(id % 4000 = 7, 100 + id div 4000, id % 50) as a", "0 as b").checkpoint()
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol=M.FEATURES_COL)
    for least in (105, 109, 110):
        tree = M.fit_surrogate(assembler.transform(rows.withColumn("IsArrDelayed", (F.col("a") >= least).cast("int"))))
        rules = M.surrogate_rules(tree, ["a", "b"], scratch_path(spark, "models/test_thresholds")).collect()
        assert sorted((r.rule, r.samples, r.delayed_share) for r in rules) == [
            (f"a <= {least - 0.5:.4f}", 90_000 - (123 - least), 0.0), (f"a > {least - 0.5:.4f}", 123 - least, 1.0)]


def test_scores_of_an_ensemble_in_many_groups(spark, monkeypatch):
    """Groups are read one after another by the same function; the scores are those of all trees."""
    rows = spark.range(500).selectExpr("id", "cast(id % 31 as double) as a", "cast(id % 7 as double) as b",
                                       "cast(id % 31 + id % 7 > 18 as int) as label")
    model = TR.fit([{**ONE_TREE[0], "numTrees": 6}], rows, ["a", "b"], "label", ["id"])["one"]
    trees = [t for g in model.groups() for t in g]
    whole = TR.Ensemble.groups
    monkeypatch.setattr(TR.Ensemble, "groups", lambda self: whole(self, most=1))
    assert len(list(model.groups())) == 6
    got = rows.select("a", "b", model.probability([F.col("a"), F.col("b")]).alias("p")).toPandas()
    assert np.allclose(got["p"], TR.predict(trees, got[["a", "b"]].to_numpy()) / 6, atol=1e-12)
