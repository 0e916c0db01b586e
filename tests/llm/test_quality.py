import numpy as np

from punctual.llm import quality
from punctual.llm.queries import QUERIES
from .util import CLASHING, ODD, docs

SF = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_quality"](spark, SF).collect()
    truth = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000
    assert auc([(r["score"], truth[r["doc_id"]]) for r in held]) > 0.8


def test_each_view_teaches_the_other():
    """Two independent views: labels are few, the pool is large; both views end better than from the labels alone."""
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 6000)
    x = y[:, None] * 1.2 + r.normal(size=(6000, 6))
    m = y[:, None] * 1.2 + r.normal(size=(6000, 6))
    few, pool, test = slice(0, 40), slice(40, 4000), slice(4000, 6000)
    alone = quality.Logistic.fit(x[few], y[few].astype(float)).predict(x[test])
    model = quality.co_train(x[few], m[few], y[few], x[pool], m[pool], 5, 300)
    taught = model.text.predict(x[test])
    assert auc(list(zip(taught, y[test]))) >= auc(list(zip(alone, y[test]))) - 0.01
    assert auc(list(zip(model.predict(x[test], m[test])[:, 2], y[test]))) > auc(list(zip(taught, y[test])))


def test_odd_rows(spark):
    frame = docs(spark, ODD, CLASHING)
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = quality.score(frame, quality.fit(frame, none)).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (3, 1)], "doc_id long, label int")
    rows = quality.score(frame.drop("lang", "n_chars"), quality.fit(frame.drop("lang", "n_chars"), some)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs(spark, []), quality.fit(frame, none)).count() == 0
