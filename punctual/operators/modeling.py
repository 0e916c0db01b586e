"""Delay classifier training, selection, scoring and model inspection.

* Preprocessing is the exact fit of :mod:`punctual.operators.prep` (median
  impute, population-std scaling, alphabetical label codes); encoded category
  codes are plain numbers (no nominal metadata), as in the reference.
* Candidates are the ensembles of :mod:`punctual.operators.trees`: six boosted
  ones (300 rounds) and two forests (300 and 500 trees, one without a depth
  limit), all fitted over one packed copy of the rows.
* Class weights are the trees' own: a positive-class weight for boosting, the
  balance of every bootstrap draw for forests.
* Candidate choice: best validation AUC, ties by accuracy, on a stratified
  80/20 split of the training rows.  All candidates are scored in one pass.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators import evaluation as E
from punctual.operators import prep, sampling, trees
from punctual.schema import MODEL_FEATURES, TARGET

FEATURES_COL = "features"
WEIGHT_COL = "class_weight"

#: Least number of bins of a feature of the surrogate tree: more than any code of the model table has today.
MAX_BINS = 256


def candidate_grid(rounds: int = 300, sizes: tuple[int, int] = (300, 500)) -> list[dict]:
    """The eight candidates: six boosted ensembles of ``rounds`` trees, two forests of ``sizes`` trees."""
    boosted = [{"name": f"gbt_d{d}_lr{lr}", "type": "gbt", "maxDepth": d, "stepSize": lr, "maxIter": rounds}
               for d in (4, 6, 8) for lr in (0.1, 0.05)]
    forests = [{"name": f"rf_{i}", "type": "rf", "numTrees": n, "maxDepth": d, "minSplit": 10, "minInstancesPerNode": least}
               for i, (n, d, least) in enumerate(zip(sizes, (20, None), (5, 4)), 1)]
    return boosted + forests


FULL_GRID = candidate_grid()
# All eight candidates with fewer rounds and trees, for tests only.
SMALL_GRID = candidate_grid(rounds=10, sizes=(10, 10))


# ---------------------------------------------------------------------------
# preprocessing
# ---------------------------------------------------------------------------
@dataclass
class Preprocessor:
    numeric: list[str]
    categorical: list[str]
    params: DataFrame          # feature, median, mean, std
    classes: DataFrame         # feature, value, code

    @property
    def features(self) -> list[str]:
        return [c for c in MODEL_FEATURES if c in self.numeric or c in self.categorical]

    @classmethod
    def fit(cls, train: DataFrame, features: list[str] = MODEL_FEATURES) -> "Preprocessor":
        prep.check_no_leakage(features)
        cat, num = prep.split_feature_types(train, features)
        params = prep.fit_impute_scale(train, num)
        classes = prep.fit_label_encoders(train, cat).checkpoint()
        return cls(num, cat, params, classes)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode categories, impute + scale numbers, add the feature vector."""
        out = prep.apply_label_encoders(df, self.classes, self.categorical)
        out = prep.apply_impute_scale(out, self.params, self.numeric)
        out = out.withColumns({c: F.col(c).cast("double") for c in self.categorical})
        return VectorAssembler(inputCols=self.features, outputCol=FEATURES_COL,
                               handleInvalid="keep").transform(out)

    def save(self, path: str) -> None:
        self.params.write.mode("overwrite").parquet(os.path.join(path, "params"))
        self.classes.write.mode("overwrite").parquet(os.path.join(path, "classes"))
        spark = self.params.sparkSession
        spark.createDataFrame([(json.dumps({"numeric": self.numeric, "categorical": self.categorical}),)],
                              "spec string").write.mode("overwrite").parquet(os.path.join(path, "spec"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        spec = json.loads(spark.read.parquet(os.path.join(path, "spec")).first()["spec"])
        return cls(spec["numeric"], spec["categorical"], spark.read.parquet(os.path.join(path, "params")),
                   spark.read.parquet(os.path.join(path, "classes")))


def with_class_weights(df: DataFrame, label: str = TARGET, of: DataFrame | None = None) -> DataFrame:
    """Balanced weights n / (2 * n_class) from the two class counts of ``of`` (default: ``df`` itself)."""
    c = (df if of is None else of).groupBy(label).count().collect()   # two rows
    n = sum(r["count"] for r in c)
    w = {r[label]: n / (2.0 * r["count"]) for r in c}
    expr = F.lit(1.0)
    for k, v in w.items():
        expr = F.when(F.col(label) == k, F.lit(v)).otherwise(expr)
    return df.withColumn(WEIGHT_COL, expr)


# ---------------------------------------------------------------------------
# candidates, selection, refit
# ---------------------------------------------------------------------------
def score(model: trees.Ensemble, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """L12 + L13: probability of the delayed class and the thresholded decision, from model-space feature columns."""
    out = df.withColumn("p_delayed", model.probability([F.col(c) for c in model.features]))
    return out.withColumn("predicted", (F.col("p_delayed") >= threshold).cast("int"))


def select_model(train: DataFrame, grid: list[dict], features: list[str], key: str, ties: list[str],
                 label: str = TARGET, seed: int = 42, parallelism: int = 4) -> tuple[DataFrame, dict]:
    """L10 (+M4): fit every candidate on 80 % of ``train`` (stratified), score the
    other 20 %, and pick the best validation AUC (ties: accuracy).

    All candidates are units of work of the same jobs, and one pass scores the
    validation rows by all of them.  The evaluations run concurrently from
    ``parallelism`` driver threads (as Spark ML's ``TrainValidationSplit`` does).
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = train.sparkSession
    split = sampling.stratified_split(train, label, 0.8, key, ties, seed=f"{seed}:val").persist(
        StorageLevel.MEMORY_AND_DISK)
    models = trees.fit(grid, split.filter(F.col("split") == "train"), features, label, ties, seed)
    columns = [F.col(c) for c in features]
    scored = split.filter(F.col("split") == "test").select(
        F.col(label).alias("label"), *[models[c["name"]].probability(columns).alias(f"s{i}") for i, c in enumerate(grid)]
    ).checkpoint()

    def evaluate(i: int):
        cand, sc = grid[i], scored.select("label", F.col(f"s{i}").alias("score"))
        auc = E.roc_auc(sc).first()["roc_auc"]
        acc = E.eval_at_threshold(sc, 0.5).first()["accuracy"]
        return (cand["name"], cand["type"], json.dumps(cand, sort_keys=True), float(auc), float(acc))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(grid)))) as pool:
        rows = list(pool.map(evaluate, range(len(grid))))
    split.unpersist()
    metrics = spark.createDataFrame(rows, "name string, type string, params string, val_auc double, val_accuracy double")
    best = sorted(rows, key=lambda r: (-r[3], -r[4], r[0]))[0]
    metrics = metrics.withColumn("selected", F.col("name") == best[0])
    return metrics, json.loads(best[2])


@dataclass
class TrainedModel:
    pre: Preprocessor
    model: trees.Ensemble
    candidate: dict
    selection: DataFrame

    def score(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return score(self.model, self.pre.transform(df), threshold)


def train(train_rows: DataFrame, grid: list[dict] = FULL_GRID, key: str = "FlightKey",
          ties: list[str] | None = None, label: str = TARGET, seed: int = 42,
          fit_rows: DataFrame | None = None) -> TrainedModel:
    """Preprocess (fit on the full train set), select, refit the winner on all fit rows.

    Only the ensembles are given ``fit_rows`` (default: all of ``train_rows``)."""
    ties = ties or [key]
    pre = Preprocessor.fit(train_rows)
    table = pre.transform(train_rows if fit_rows is None else fit_rows).select(*ties, label, *pre.features) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    selection, best = select_model(table, grid, pre.features, key, ties, label, seed)
    model = trees.fit([best], table, pre.features, label, ties, seed)[best["name"]]
    table.unpersist()
    return TrainedModel(pre, model, best, selection)


# ---------------------------------------------------------------------------
# L15 importances, L16/L17 surrogate tree
# ---------------------------------------------------------------------------
def feature_importance(model, features: list[str]) -> DataFrame:
    """Importances ranked, as percent of total and scaled to the maximum."""
    spark = SparkSession.getActiveSession()
    imp = model.importances() if isinstance(model, trees.Ensemble) else dict(zip(features, model.featureImportances.toArray()))
    total, top = float(sum(imp.values())) or 1.0, float(max(imp.values())) or 1.0
    rows = sorted([(f, float(imp[f])) for f in features], key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(i + 1, f, v, 100.0 * v / total, v / top) for i, (f, v) in enumerate(rows)],
        "rank int, feature string, importance double, importance_pct double, importance_scaled double")


def fit_surrogate(vec: DataFrame, label: str = TARGET, fit_on: str = "label", max_depth: int = 3, seed: int = 42):
    """Shallow balanced tree; ``fit_on='prediction'`` fits the model's decisions instead of labels.

    Spark takes the thresholds it tries from a sample of maxBins^2 rows, so there are as many bins as make that all rows."""
    target = label if fit_on == "label" else "predicted"
    d = with_class_weights(vec.withColumn("__y", F.col(target).cast("double")), "__y")
    bins = max(MAX_BINS, math.isqrt(d.count()) + 1)
    return DecisionTreeClassifier(featuresCol=FEATURES_COL, labelCol="__y", weightCol=WEIGHT_COL,
                                  maxDepth=max_depth, maxBins=bins, seed=seed).fit(d)


def tree_nodes(model, path: str) -> "list[dict]":
    """Node table of a saved tree model (read back from its parquet data)."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    data = spark.read.parquet(os.path.join(path, "data"))
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    return [r.asDict(recursive=True) for r in data.collect()]  # model-sized, not data-sized


def surrogate_rules(model, features: list[str], path: str) -> DataFrame:
    """One row per leaf: rule text, depth, samples, delayed share, predicted class."""
    nodes = {n["id"]: n for n in tree_nodes(model, path)}
    out = []

    def walk(i, conds):
        n = nodes[i]
        if n["leftChild"] < 0:
            stats = n["impurityStats"]
            tot = sum(stats) or 1.0
            out.append((" AND ".join(conds) or "(all)", len(conds), int(n["rawCount"]),
                        float(stats[1] / tot) if len(stats) > 1 else 0.0, int(n["prediction"])))
            return
        f = features[n["split"]["featureIndex"]]
        t = n["split"]["leftCategoriesOrThreshold"][0]
        walk(n["leftChild"], conds + [f"{f} <= {t:.4f}"])
        walk(n["rightChild"], conds + [f"{f} > {t:.4f}"])

    walk(0, [])
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(out, "rule string, depth int, samples long, delayed_share double, predicted int")


def tree_stats(model) -> dict:
    """Depth, node count and leaf count of a single tree."""
    return {"depth": model.depth, "nodes": model.numNodes, "leaves": (model.numNodes + 1) // 2}
