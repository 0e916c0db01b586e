"""Model properties: quality floor, attribution additivity, persistence, what-if."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from punctual.operators import explain as X
from punctual.operators import modeling as M
from punctual.operators import trees as TR
from punctual.plans import pipeline as PL
from punctual.session import scratch_path
from punctual.sources.flights import ROW_KEY

TINY_GRID = [{"name": "gbt", "type": "gbt", "maxDepth": 3, "stepSize": 0.1, "maxIter": 5},
             {"name": "rf", "type": "rf", "numTrees": 5, "maxDepth": None, "minSplit": 10, "minInstancesPerNode": 5}]
KEY = list(ROW_KEY)


@pytest.fixture(scope="module")
def trained(spark):
    return M.train(PL.balanced_train(spark, SF_SMALL), TINY_GRID, "FlightKey", KEY)


def test_selection_and_quality_floor(spark, trained):
    sel = trained.selection.collect()
    assert len(sel) == 2 and sum(r.selected for r in sel) == 1
    from punctual.operators.evaluation import roc_auc
    sc = trained.score(PL.test_split(spark, SF_SMALL)).select(F.col("IsArrDelayed").alias("label"),
                                                             F.col("p_delayed").alias("score"))
    assert roc_auc(sc).first().roc_auc > 0.6


@pytest.mark.parametrize("which", ["selected", "gbt", "rf"])
def test_attributions_add_up(spark, trained, which):
    t = trained
    if which != "selected":
        cand = [c for c in TINY_GRID if c["name"] == which][0]
        table = t.pre.transform(PL.balanced_train(spark, SF_SMALL))
        t = M.TrainedModel(t.pre, TR.fit([cand], table, t.pre.features, "IsArrDelayed", KEY)[which], cand, t.selection)
    rows = PL.test_split(spark, SF_SMALL).limit(200)
    attr = X.attributions(t, rows, KEY)
    tot = attr.groupBy(*KEY).agg((F.sum("phi") + F.first("base_value")).alias("total"))
    out = X.model_output(t, rows, KEY)
    diff = tot.join(out, KEY).select(F.max(F.abs(F.col("total") - F.col("model_output")))).first()[0]
    assert diff < 1e-9


def test_roundtrip(spark, trained):
    d = scratch_path(spark, "models/test_roundtrip")
    trained.model.save(os.path.join(d, "m"))
    trained.pre.save(os.path.join(d, "p"))
    back = M.TrainedModel(M.Preprocessor.load(spark, os.path.join(d, "p")),
                          TR.Ensemble.load(spark, os.path.join(d, "m")), trained.candidate, trained.selection)
    test = PL.test_split(spark, SF_SMALL)
    a = trained.score(test).select(*KEY, F.col("p_delayed").alias("a"))
    b = back.score(test).select(*KEY, F.col("p_delayed").alias("b"))
    assert a.join(b, KEY).filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_what_if_identity_and_changes(spark, trained):
    base = PL.test_split(spark, SF_SMALL).limit(30)
    kinds = spark.createDataFrame([(1, "Airline", "Brand#11"), (2, "DepHour", None)],
                                  "scenario_id long, feature string, override_value string")
    sc = base.select(*KEY).crossJoin(kinds)
    res, changes = X.what_if(trained, base, sc, KEY, ["Airline", "DepHour"])
    d = {r.scenario_id: r for r in res.groupBy("scenario_id").agg(F.max(F.abs("delta")).alias("m")).collect()}
    assert d[2].m == 0.0                       # no override -> unchanged
    ch = changes.collect()
    assert all(r.feature == "Airline" and r.new_value == "Brand#11" and r.old_value != "Brand#11" for r in ch)


def test_surrogate_rules(spark, trained):
    vec = trained.pre.transform(PL.balanced_train(spark, SF_SMALL))
    tree = M.fit_surrogate(vec)
    rules = M.surrogate_rules(tree, trained.pre.features, scratch_path(spark, "models/test_surrogate")).collect()
    assert len(rules) == M.tree_stats(tree)["leaves"] and all(r.depth <= 3 for r in rules)


def test_adjustable_features(spark):
    imp = spark.createDataFrame([(1, "Quarter"), (2, "Month"), (3, "DepHour"), (4, "MonthName"), (5, "Airline")],
                                "rank int, feature string")
    model = ["Quarter", "Month", "MonthName", "DepHour", "Airline"]
    # Month gives way to MonthName, which keeps its own rank
    assert [tuple(r) for r in X.adjustable_features(imp, model).collect()] == [("DepHour", 3), ("MonthName", 4), ("Airline", 5)]
    # where MonthName is not among the first ten it takes Month's rank
    assert [tuple(r) for r in X.adjustable_features(imp.filter("rank <> 4"), model).collect()] == [
        ("MonthName", 2), ("DepHour", 3), ("Airline", 5)]
    # the stand-in is offered only where the model has it
    assert [r[0] for r in X.adjustable_features(imp, ["Month"]).collect()] == ["Month", "DepHour", "MonthName", "Airline"]


def test_the_grid_is_the_whole_one():
    assert len(M.FULL_GRID) == 8 and {c["maxIter"] for c in M.FULL_GRID if c["type"] == "gbt"} == {300}
    assert [(c["numTrees"], c["maxDepth"]) for c in M.FULL_GRID if c["type"] == "rf"] == [(300, 20), (500, None)]


def test_delta_rescoring_equals_full_rescoring(spark, trained):
    group = [t for g in trained.model.groups() for t in g]
    rng = np.random.default_rng(2)
    base = np.stack([rng.choice([c[0] - 1, *(np.array(c) + 0.1)] if c else [0.0], 300) for c in trained.model.cuts], axis=1)
    changed = base.copy()
    changed[:100, 2] = rng.permutation(changed[:100, 2])
    changed[50:150, 6] += 3.0
    before, after, visited = X.delta_margins(group, base, changed)
    assert np.allclose(before, TR.predict(group, base)) and np.allclose(after, TR.predict(group, changed))
    reads = X.trees_reading(group, base.shape[1])
    assert (visited[200:] == 0).all() and visited.max() <= len(group)
    assert (visited <= (reads[2] | reads[6]).sum()).all()


def test_model_metrics_equal_sql_over_its_scores(spark, tmp_path):
    """The evaluation of a trained model's scores against SQL over the same scores."""
    import duckdb

    from punctual.operators import evaluation as E
    from punctual.plans import q_modeling as Q
    scores = Q.model_scores(spark, SF_SMALL)
    path = str(tmp_path / "scores")
    scores.write.parquet(path)
    want = duckdb.sql(f"""SELECT count_if(score >= 0.5 AND label = 1), count_if(score >= 0.5 AND label = 0),
        count_if(score < 0.5 AND label = 1), count_if(score < 0.5 AND label = 0) FROM '{path}/*.parquet'""").fetchall()[0]
    got = Q.model_evaluation(spark, SF_SMALL).first()
    assert tuple(got[c] for c in ("tp", "fp", "fn", "tn")) == want
    auc = duckdb.sql(f"""WITH s AS (SELECT * FROM '{path}/*.parquet') SELECT avg((p.score > n.score)::INT
        + (p.score = n.score)::INT / 2.0) FROM s p, s n WHERE p.label = 1 AND n.label = 0""").fetchall()[0][0]
    assert abs(got["roc_auc"] - auc) < 1e-9
    assert Q.operating_threshold(spark, SF_SMALL) in E.SWEEP
    summary = Q.model_summary(spark, SF_SMALL).first()
    assert len(summary) >= 20 and summary["test_rows"] == scores.count() and len(summary["sweep"]) == 17
    assert PL.test_split(spark, SF_SMALL).count() > 0.3 * 5000   # no cut: the split covers all flights


def test_attribution_views_of_a_row(spark, trained):
    rows = PL.test_split(spark, SF_SMALL).limit(20)
    feats = trained.pre.features
    attr = X.attribution_rows(trained, rows, KEY).checkpoint()
    want = {tuple(r[k] for k in KEY): sorted(((-abs(p), f, v, p) for f, v, p in zip(feats, r.x, r.phi)))[:15]
            for r in attr.collect()}
    base = attr.first().base_value
    got = {}
    for r in X.contribution_path(attr, KEY, feats).collect():
        got.setdefault(tuple(r[k] for k in KEY), []).append((r["rank"], r.feature, r.phi, r.cumulative))
    for key, top in want.items():
        total = base
        for (rank, f, phi, cum), (_, wf, _, wp) in zip(sorted(got[key]), top):
            total += wp
            assert f == wf and phi == wp and abs(cum - total) < 1e-9
    local = X.local_explanation(attr, KEY, feats).collect()
    assert len(local) == sum(map(len, want.values())) and {r["rank"] for r in local} == set(range(1, min(15, len(feats)) + 1))
    series, _ = X.dependence(attr, KEY, feats, feats[0], feats[1])
    assert series.count() == 20 and "Exchange" not in series._jdf.queryExecution().executedPlan().toString()


def test_preprocessing_covers_rows_that_are_not_fitted(spark):
    from punctual.operators import prep
    from punctual.plans import q_modeling as Q
    full = PL.balanced_train(spark, SF_SMALL)
    t = Q.trained(spark, SF_SMALL, TINY_GRID[1:], max_fit_rows=60)
    want = M.Preprocessor.fit(full)
    assert sorted(map(tuple, t.pre.classes.collect())) == sorted(map(tuple, want.classes.collect()))
    assert sorted(map(tuple, t.pre.params.collect())) == sorted(map(tuple, want.params.collect()))
    few = prep.fit_label_encoders(PL.fit_rows(spark, SF_SMALL, 60), t.pre.categorical)
    assert few.count() < t.pre.classes.count()
    weights = M.with_class_weights(PL.fit_rows(spark, SF_SMALL, 60), of=full).select("IsArrDelayed", "class_weight")
    n = {r["IsArrDelayed"]: r["count"] for r in full.groupBy("IsArrDelayed").count().collect()}
    assert all(abs(r.class_weight - sum(n.values()) / 2 / n[r.IsArrDelayed]) < 1e-9 for r in weights.distinct().collect())
