"""Binary-classifier evaluation on a (label, score) table.

Scale design:

* Fixed-threshold metrics (confusion matrix, report, 17-threshold sweep) need
  one pass: every row is bucketed once by how many thresholds it reaches, a
  (bucket, label) count table of at most 2 x (T+1) rows is aggregated map-side,
  and a reverse running sum over those few rows gives TP/FP per threshold.  No
  per-threshold pass and no row x threshold expansion.
* ROC points and ROC-AUC need running sums over *distinct scores*, whose count
  can grow with the data: ``common.prefix_sums`` cuts them into ranges, sums
  inside each and adds what lies before it -- one path at every size, no
  single-partition window.
* Zero denominators give 0 (``zero_division=0``), never null or an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.common import prefix_sums

SWEEP = [round(k * 0.05, 2) for k in range(2, 19)]  # 0.10, 0.15, ..., 0.90


def _div0(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def _prf(tp, fp, fn) -> dict[str, Column]:
    return {"precision": _div0(tp, tp + fp), "recall": _div0(tp, tp + fn),
            "f1": _div0(2 * tp, 2 * tp + fp + fn)}


# ---------------------------------------------------------------------------
# threshold metrics
# ---------------------------------------------------------------------------
def threshold_counts(scored: DataFrame, thresholds: list[float], label: str = "label",
                     score: str = "score") -> DataFrame:
    """TP/FP/FN/TN for every threshold (prediction = score >= threshold), one pass."""
    spark = scored.sparkSession
    thr = sorted(thresholds)
    s = F.col(score)
    idx = sum((F.when(s >= t, 1).otherwise(0) for t in thr), F.lit(0))
    b = (scored.select(idx.alias("idx"), F.col(label).cast("int").alias("y"))
               .groupBy("idx").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))
    dim = spark.createDataFrame([(i + 1, t) for i, t in enumerate(thr)], "idx int, threshold double")
    # ``b`` has at most len(thresholds)+1 rows; the windows below run on that tiny table
    allrows = Window.partitionBy(F.lit(0))
    w = allrows.orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = dim.join(F.broadcast(b), "idx", "full").fillna({"pos": 0, "neg": 0})
    cum = full.select("threshold", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                      F.sum("pos").over(allrows).alias("P"), F.sum("neg").over(allrows).alias("N"))
    return cum.filter(F.col("threshold").isNotNull()).select(
        "threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("P") - F.col("tp")).cast("long").alias("fn"), (F.col("N") - F.col("fp")).cast("long").alias("tn"))


def sweep_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and per-class precision / recall / F1 for each threshold."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m1, m0 = _prf(tp, fp, fn), _prf(tn, fn, fp)
    return counts.select(
        "threshold", _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        m0["precision"].alias("precision_0"), m0["recall"].alias("recall_0"), m0["f1"].alias("f1_0"),
        m1["precision"].alias("precision_1"), m1["recall"].alias("recall_1"), m1["f1"].alias("f1_1"),
    ).orderBy("threshold")


def threshold_sweep(scored: DataFrame, thresholds: list[float] = SWEEP, **kw) -> DataFrame:
    return sweep_metrics(threshold_counts(scored, thresholds, **kw))


def eval_at_threshold(scored: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """E1 + E5: counts, accuracy, class-1 P/R/F1, false-positive and false-negative rates."""
    c = threshold_counts(scored, [threshold], **kw)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m1 = _prf(tp, fp, fn)
    return c.select("threshold", "tp", "fp", "fn", "tn",
                    _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    m1["precision"].alias("precision_1"), m1["recall"].alias("recall_1"), m1["f1"].alias("f1_1"),
                    _div0(fp, fp + tn).alias("fpr"), _div0(fn, fn + tp).alias("fnr"))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                     score: str = "score") -> DataFrame:
    """(actual, predicted) cell counts and percent of all rows (all 4 cells)."""
    pred = (F.col(score) >= threshold).cast("int")
    cells = scored.groupBy(F.col(label).cast("int").alias("actual"), pred.alias("predicted")) \
                  .agg(F.count(F.lit(1)).alias("count"))
    grid = scored.sparkSession.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)],
                                               "actual int, predicted int")
    out = grid.join(F.broadcast(cells), ["actual", "predicted"], "left").fillna({"count": 0})
    return out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(0))))


def classification_report(scored: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    c = threshold_counts(scored, [threshold], **kw)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m1, m0 = _prf(tp, fp, fn), _prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = [
        ("0", m0["precision"], m0["recall"], m0["f1"], s0),
        ("1", m1["precision"], m1["recall"], m1["f1"], s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _div0(tp + tn, n), n),
        ("macro avg", (m0["precision"] + m1["precision"]) / 2, (m0["recall"] + m1["recall"]) / 2,
         (m0["f1"] + m1["f1"]) / 2, n),
        ("weighted avg", _div0(m0["precision"] * s0 + m1["precision"] * s1, n),
         _div0(m0["recall"] * s0 + m1["recall"] * s1, n), _div0(m0["f1"] * s0 + m1["f1"] * s1, n), n),
    ]
    structs = [F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support")) for k, p, r, f, s in rows]
    return c.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def operating_point(sweep: DataFrame, min_recall: float = 0.75) -> DataFrame:
    """Among thresholds with recall_1 >= min_recall the best F1 (lowest
    threshold on ties); if none qualifies, the threshold with the best recall."""
    ok = F.col("recall_1") >= min_recall
    key = F.when(ok, F.col("f1_1")).otherwise(F.col("recall_1"))
    return sweep.orderBy(ok.desc(), key.desc(), F.col("threshold").asc()).limit(1)


def nearest_threshold(sweep: DataFrame, x: float) -> DataFrame:
    """The sweep row whose threshold is closest to ``x`` (lower wins ties)."""
    return sweep.orderBy(F.abs(F.col("threshold") - F.lit(x)), F.col("threshold")).limit(1)


# ---------------------------------------------------------------------------
# ROC (distinct scores) and AUC
# ---------------------------------------------------------------------------
def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation map-side)."""
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_table(scored: DataFrame, label: str = "label", score: str = "score",
              buckets: int | None = None) -> tuple[DataFrame, int, int]:
    """Per distinct score s: pos, neg, tps = positives with score >= s, fps
    likewise; plus the totals P and N.  ``buckets``: ranges of the running sum
    (default ``spark.sql.shuffle.partitions``)."""
    counts = score_counts(scored, label, score).filter(F.col("score").isNotNull())
    sums = prefix_sums(counts, [F.col("score").desc()], ["pos", "neg"], parts=buckets)
    table = sums.select("score", "pos", "neg", F.col("cum_pos").cast("long").alias("tps"),
                        F.col("cum_neg").cast("long").alias("fps")).checkpoint()
    st = table.agg(F.max("tps").alias("P"), F.max("fps").alias("N")).first()
    return table, int(st["P"] or 0), int(st["N"] or 0)


def roc_curve(scored: DataFrame, **kw) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the (0, 0) start
    point with a null threshold.  All points are kept (no collinear dropping)."""
    t, P, N = roc_table(scored, **kw)
    curve = t.select(F.col("score").alias("threshold"), _div0(F.col("fps"), F.lit(N)).alias("fpr"),
                     _div0(F.col("tps"), F.lit(P)).alias("tpr"), "tps", "fps")
    start = scored.sparkSession.createDataFrame([(None, 0.0, 0.0, 0, 0)],
                                                "threshold double, fpr double, tpr double, tps long, fps long")
    return start.unionByName(curve).orderBy(F.col("threshold").desc_nulls_first())


def roc_auc(scored: DataFrame, **kw) -> DataFrame:
    """ROC-AUC by the rank-sum rule (tied scores count one half):
    AUC = sum_s pos_s * (N - fps_s + neg_s / 2) / (P * N)."""
    t, P, N = roc_table(scored, **kw)
    s = t.agg(F.sum(F.col("pos") * (F.lit(float(N)) - F.col("fps") + 0.5 * F.col("neg"))).alias("__s"))
    return s.select(_div0(F.col("__s"), F.lit(float(P) * float(N))).alias("roc_auc"),
                    F.lit(P).cast("long").alias("n_pos"), F.lit(N).cast("long").alias("n_neg"))


def roc_at(scored: DataFrame, steps: int = 1000, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at ``steps`` + 1 even thresholds from 1 to 0, and the start point (threshold null):
    exact rates on a grid of fixed size, for records; :func:`roc_curve` has every distinct score."""
    s = F.col(score).cast("double")
    k = F.floor(s * steps).cast("int")
    # the product may round across a step
    k = k + F.when(s >= (k + 1) / F.lit(float(steps)), 1).otherwise(0) - F.when(s < k / F.lit(float(steps)), 1).otherwise(0)
    cells = scored.filter(s.isNotNull()).groupBy(F.greatest(F.least(k, F.lit(steps)), F.lit(0)).alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    down = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)        # over the grid only
    at = grid.join(F.broadcast(cells), "k", "left").fillna(0, ["pos", "neg"]).select(
        "k", F.sum("pos").over(down).alias("tps"), F.sum("neg").over(down).alias("fps"))
    whole = Window.partitionBy(F.lit(0))
    rates = at.select((F.col("k") / F.lit(float(steps))).alias("threshold"),
                      _div0(F.col("fps"), F.max("fps").over(whole)).alias("fpr"),
                      _div0(F.col("tps"), F.max("tps").over(whole)).alias("tpr"))
    start = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(rates).orderBy(F.col("threshold").desc_nulls_first())
