"""Registered modelling / scoring / explanation queries.

Model training is iterative and seeded but its floating-point results are not
reproducible by SQL, so these queries carry no oracle SQL; pytest checks their
properties instead (AUC floor, additivity of attributions, round trips).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from punctual.functions import features as fx
from punctual.operators import evaluation as E
from punctual.operators import explain as X
from punctual.operators import modeling as M
from punctual.operators import routes
from punctual.operators import trees as TR
from punctual.plans import pipeline as PL
from punctual.plans.catalog import register
from punctual.plans.q_sampling import requests
from punctual.schema import TARGET
from punctual.session import fresh_path
from punctual.sources import artifacts as AR
from punctual.sources.flights import ROW_KEY, fingerprint

KEY = list(ROW_KEY)
#: Candidates that the registered queries fit (tests put a smaller grid here).
GRID = M.FULL_GRID
_MODELS: dict[tuple, M.TrainedModel] = {}


def trained(spark, sf_dir, grid=None, max_fit_rows: int | None = None) -> M.TrainedModel:
    """Fit once per session, input, grid and bound: preprocessing, selection and estimators on the whole balanced train
    set.  Only a caller that gives ``max_fit_rows`` has the estimators see that many rows of it."""
    grid = grid or GRID
    k = (spark.sparkContext.applicationId, fingerprint(spark, sf_dir), json.dumps(grid, sort_keys=True), max_fit_rows)
    if k not in _MODELS:
        _MODELS[k] = M.train(PL.balanced_train(spark, sf_dir), grid, "FlightKey", KEY,
                             fit_rows=PL.fit_rows(spark, sf_dir, max_fit_rows))
    return _MODELS[k]


def _model_dir(spark, name: str) -> str:
    return fresh_path(spark, f"models/{name}")


@register("model_selection")
def model_selection(spark, sf_dir):
    """Validation AUC / accuracy of every candidate, winner flagged."""
    return trained(spark, sf_dir).selection


@register("score_batch")
def score_batch(spark, sf_dir):
    """Probability and decision for every row of the test split."""
    t = trained(spark, sf_dir)
    return t.score(PL.test_split(spark, sf_dir)).select(*KEY, TARGET, "p_delayed", "predicted")


def request_features(spark, sf_dir):
    """Request table -> model columns (date parts, hour, blocks, distance)."""
    r = routes.fill_distance(requests(spark, sf_dir), PL.route_counts(spark, sf_dir))
    hhmm = (F.split("DepTime", ":")[0].cast("int") * 100 + F.split("DepTime", ":")[1].cast("int"))
    r = r.withColumn("CRSDepTime", hhmm.cast("int"))
    r = fx.add_clock(fx.add_temporal(r))
    from punctual.operators.prep import add_serving_columns
    return add_serving_columns(r)


@register("score_requests")
def score_requests(spark, sf_dir):
    """Score a batch of planned-trip requests end to end."""
    t = trained(spark, sf_dir)
    s = t.score(request_features(spark, sf_dir))
    risk = F.col("p_delayed") * 100
    recall_at = operating_threshold(spark, sf_dir)
    return s.select("request_id", "FlightDate", "Airline", "Origin", "Dest", "DepTime", "Distance", "p_delayed",
                    "predicted", (F.col("p_delayed") >= recall_at).cast("int").alias("predicted_high_recall"),
                    F.when(risk < 20, "Low").when(risk < 40, "Medium").otherwise("High").alias("risk_level"))


# ---------------------------------------------------------------------------
# E1-E11 on the trained model's scores of the test split
# ---------------------------------------------------------------------------
_SCORED: dict[tuple, object] = {}


def model_scores(spark, sf_dir):
    """(label, score) of the whole test split, written once."""
    k = (spark.sparkContext.applicationId, fingerprint(spark, sf_dir))
    if k not in _SCORED:
        t = trained(spark, sf_dir)
        _SCORED[k] = t.score(PL.test_split(spark, sf_dir)).select(
            F.col(TARGET).alias("label"), F.col("p_delayed").alias("score")).checkpoint()
    return _SCORED[k]


def operating_threshold(spark, sf_dir) -> float:
    """The model's high-recall operating point."""
    return float(E.operating_point(E.threshold_sweep(model_scores(spark, sf_dir))).first()["threshold"])


@register("model_evaluation")
def model_evaluation(spark, sf_dir):
    """Counts, rates and ROC-AUC of the trained model on the test split."""
    s = model_scores(spark, sf_dir)
    auc = E.roc_auc(s).first()["roc_auc"]
    return E.eval_at_threshold(s, 0.5).withColumn("roc_auc", F.lit(auc))


@register("model_report")
def model_report(spark, sf_dir):
    """Per-class report of the trained model."""
    return E.classification_report(model_scores(spark, sf_dir), 0.5)


@register("model_threshold_sweep")
def model_threshold_sweep(spark, sf_dir):
    """The 17 thresholds on the trained model's scores."""
    return E.threshold_sweep(model_scores(spark, sf_dir))


@register("model_roc_curve")
def model_roc_curve(spark, sf_dir):
    """ROC points of the trained model."""
    return E.roc_curve(model_scores(spark, sf_dir))


@register("model_summary")
def model_summary(spark, sf_dir):
    """One record of the build: sizes, rates, winner, validation and test metrics, default threshold and operating
    point, confusion matrix, report, sweep, ROC arrays, importances, class names."""
    t = trained(spark, sf_dir)
    s = model_scores(spark, sf_dir)
    fit = PL.balanced_train(spark, sf_dir)
    both = s.agg(F.count(F.lit(1)).alias("test_rows"), F.avg(F.col("label").cast("double")).alias("test_delay_rate"))
    train = fit.agg(F.count(F.lit(1)).alias("train_rows"), F.avg(F.col(TARGET).cast("double")).alias("train_delay_rate"))
    best = t.selection.filter("selected").select(
        F.col("name").alias("model_name"), F.col("type").alias("model_type"), "val_auc", "val_accuracy",
        F.col("params").alias("model_params"))
    at = model_evaluation(spark, sf_dir).select(
        F.col("accuracy").alias("test_accuracy"), F.col("precision_1").alias("test_precision"),
        F.col("recall_1").alias("test_recall"), F.col("f1_1").alias("test_f1"), F.col("roc_auc").alias("test_auc"),
        F.array("tn", "fp", "fn", "tp").alias("confusion_matrix"), F.col("threshold").alias("default_threshold"))
    point = E.operating_point(model_threshold_sweep(spark, sf_dir)).select(
        F.col("threshold").alias("high_recall_threshold"), F.col("recall_1").alias("high_recall_recall"))

    def listed(df, name):
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    # the curve on a fixed grid of thresholds, highest first; model_roc_curve has every distinct score
    points = E.roc_at(s).agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce(-F.col("threshold"), F.lit(-2.0)).alias("by"), "threshold", "fpr", "tpr"))).alias("p"))
    roc = points.select(F.col("p.fpr").alias("fpr"), F.col("p.tpr").alias("tpr"), F.col("p.threshold").alias("roc_thresholds"))
    parts = [both, train, best, at, point, roc,
             listed(E.classification_report(s, 0.5), "report"), listed(model_threshold_sweep(spark, sf_dir), "sweep"),
             listed(M.feature_importance(t.model, t.pre.features), "importances")]
    # each part is one row: their columns become scalars of one record
    out = spark.range(1).select(F.array(F.lit("On-Time"), F.lit("Delayed")).alias("class_names"))
    return out.select("*", *[p.select(c).scalar().alias(c) for p in parts for c in p.columns])


@register("adjustable_features")
def adjustable_features(spark, sf_dir):
    """The most important features that a user may change."""
    t = trained(spark, sf_dir)
    return X.adjustable_features(M.feature_importance(t.model, t.pre.features), t.pre.features)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Importances of the selected model."""
    t = trained(spark, sf_dir)
    return M.feature_importance(t.model, t.pre.features)


@register("surrogate_tree")
def surrogate_tree(spark, sf_dir):
    """Depth-3 balanced tree on the training labels, as leaf rules
    with the tree's size statistics."""
    t = trained(spark, sf_dir)
    vec = t.pre.transform(PL.fit_rows(spark, sf_dir))
    tree = M.fit_surrogate(vec)
    st = M.tree_stats(tree)
    rules = M.surrogate_rules(tree, t.pre.features, _model_dir(spark, "surrogate"))
    return rules.withColumns({k: F.lit(v) for k, v in {"tree_depth": st["depth"], "tree_nodes": st["nodes"],
                                                        "tree_leaves": st["leaves"]}.items()})


_ATTR: dict[tuple, object] = {}


def attribution_table(spark, sf_dir):
    """X1 over the whole test split, one array per row, written once to the checkpoint folder."""
    k = (spark.sparkContext.applicationId, fingerprint(spark, sf_dir))
    if k not in _ATTR:
        t = trained(spark, sf_dir)
        a = X.attribution_rows(t, PL.test_split(spark, sf_dir), KEY)
        _ATTR[k] = a.checkpoint()
    return _ATTR[k]


def _feats(spark, sf_dir) -> list[str]:
    return trained(spark, sf_dir).pre.features


@register("attributions")
def attributions(spark, sf_dir):
    """Per row and feature: model-space value, attribution, base value."""
    return X.long_form(attribution_table(spark, sf_dir), KEY, _feats(spark, sf_dir))


@register("attribution_global")
def attribution_global(spark, sf_dir):
    """Mean absolute attribution per feature."""
    return X.global_importance(attributions(spark, sf_dir))


@register("attribution_local")
def attribution_local(spark, sf_dir):
    """Top-15 contributions of every explained row."""
    return X.local_explanation(attribution_table(spark, sf_dir), KEY, _feats(spark, sf_dir))


@register("attribution_path")
def attribution_path(spark, sf_dir):
    """Running total from the base value over each row's top 15."""
    return X.contribution_path(attribution_table(spark, sf_dir), KEY, _feats(spark, sf_dir))


@register("attribution_dependence")
def attribution_dependence(spark, sf_dir):
    """Dependence series of the most important feature, coloured by the second."""
    t = trained(spark, sf_dir)
    imp = [r["feature"] for r in M.feature_importance(t.model, t.pre.features).orderBy("rank").limit(2).collect()]
    series, trend = X.dependence(attribution_table(spark, sf_dir), KEY, t.pre.features, imp[0], imp[1])
    return series.select(
        "*", F.lit(imp[0]).alias("feature"), F.lit(imp[1]).alias("colour_feature"),
        trend.select("slope").scalar().alias("trend_slope"),
        trend.select("intercept").scalar().alias("trend_intercept"))


def _scenarios(spark, sf_dir):
    """A scenario for each test row, of one of three kinds by the row's hash."""
    kinds = [[("DepHour", "6"), ("DepTimeOfDay", "Morning (6-12)")], [("Airline", "Brand#11")],
             [("DepHour", "19"), ("DepTimeOfDay", "Evening (18-24)"), ("Distance", "2500")]]
    listed = F.array(*[F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("override_value"))
                                 for f, v in kind]) for kind in kinds])
    number = F.pmod(F.xxhash64(*KEY), F.lit(len(kinds))).cast("int")
    return PL.test_split(spark, sf_dir).select(
        *KEY, (number + 1).cast("long").alias("scenario_id"), F.explode(listed[number]).alias("o")) \
        .select(*KEY, "scenario_id", "o.feature", "o.override_value")


WHAT_IF_FEATURES = ["DepHour", "DepTimeOfDay", "Airline", "Distance"]


@register("what_if")
def what_if(spark, sf_dir):
    """Rescored probability per test row and scenario, with the change."""
    t = trained(spark, sf_dir)
    res, _ = X.what_if(t, PL.test_split(spark, sf_dir), _scenarios(spark, sf_dir), KEY, WHAT_IF_FEATURES)
    return res


@register("what_if_changes")
def what_if_changes(spark, sf_dir):
    """Old -> new value of every overridden feature that actually changes."""
    t = trained(spark, sf_dir)
    _, ch = X.what_if(t, PL.test_split(spark, sf_dir), _scenarios(spark, sf_dir), KEY, WHAT_IF_FEATURES)
    return ch


def artifacts(spark, sf_dir) -> tuple[dict, dict]:
    """(tables, plain values) of the build: model, preprocessing, metrics record, selection, surrogate, attributions."""
    t = trained(spark, sf_dir)
    tables = {"model": t.model.trees, "imputer_scaler": t.pre.params, "label_encoders": t.pre.classes,
              "metrics": model_summary(spark, sf_dir), "selection": t.selection,
              "surrogate": surrogate_tree(spark, sf_dir), "attributions": attribution_table(spark, sf_dir)}
    return tables, {"model": t.model.about(), "numeric": t.pre.numeric, "categorical": t.pre.categorical,
                    "candidate": t.candidate}


def restored(tables: dict, about: dict) -> M.TrainedModel:
    """The trained model of a loaded version."""
    pre = M.Preprocessor(about["numeric"], about["categorical"], tables["imputer_scaler"], tables["label_encoders"])
    return M.TrainedModel(pre, TR.Ensemble.of(tables["model"], about["model"]), about["candidate"], tables["selection"])


@register("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Publish every artifact of the build as one version, load it, and compare each with its origin; the last row
    compares the scores of the restored model on the test split."""
    tables, about = artifacts(spark, sf_dir)
    tables = {k: v.checkpoint() for k, v in tables.items()}
    base = _model_dir(spark, "store")
    AR.publish(spark, base, tables, about)
    back, told = AR.load(spark, base)
    rows = []
    for name, a in tables.items():
        b = back[name]
        rows.append((name, a.count(), b.count(), a.exceptAll(b).count() + b.exceptAll(a).count()))
    test, loaded = PL.test_split(spark, sf_dir), restored(back, told)
    a = trained(spark, sf_dir).score(test).select(*KEY, F.col("p_delayed").alias("p_before"))
    b = loaded.score(test).select(*KEY, F.col("p_delayed").alias("p_after"))
    rows.append(("scores", a.count(), b.count(), a.join(b, KEY).filter("abs(p_before - p_after) > 1e-12").count()))
    return spark.createDataFrame(rows, "artifact string, rows long, rows_loaded long, rows_different long")


@register("attribution_feature_corr")
def attribution_feature_corr(spark, sf_dir):
    """Pearson matrix of the ten most important features, in model space,
    over the explained (test) rows."""
    from pyspark.ml.functions import vector_to_array

    from punctual.operators.distribution import corr_matrix
    t = trained(spark, sf_dir)
    top = [r["feature"] for r in M.feature_importance(t.model, t.pre.features).orderBy("rank").limit(10).collect()]
    feats = t.pre.features
    vec = t.pre.transform(PL.test_split(spark, sf_dir)).select(vector_to_array(M.FEATURES_COL).alias("v"))
    wide = vec.select(*[F.col("v")[feats.index(f)].alias(f) for f in top])
    return corr_matrix(wide, top)


@register("surrogate_on_predictions")
def surrogate_on_predictions(spark, sf_dir):
    """The same tree fitted on the model's decisions, with the share of fit rows on which both agree."""
    t = trained(spark, sf_dir)
    vec = t.score(PL.fit_rows(spark, sf_dir)).select("predicted", M.FEATURES_COL).checkpoint()
    tree = M.fit_surrogate(vec, fit_on="prediction")
    agree = tree.transform(vec).agg(F.avg((F.col("prediction") == F.col("predicted")).cast("double")).alias("a")).first()["a"]
    rules = M.surrogate_rules(tree, t.pre.features, _model_dir(spark, "surrogate"))
    return rules.withColumn("agreement", F.lit(agree))


@register("surrogate_importance")
def surrogate_importance(spark, sf_dir):
    """L17/P-13: split importances of the surrogate tree, positive ones only."""
    t = trained(spark, sf_dir)
    tree = M.fit_surrogate(t.pre.transform(PL.fit_rows(spark, sf_dir)))
    return M.feature_importance(tree, t.pre.features).filter(F.col("importance") > 0)
