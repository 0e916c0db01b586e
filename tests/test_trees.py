"""Tree ensembles against a plain trainer, and independence of how the work is cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import trees as T

GBT = {"name": "gbt", "type": "gbt", "maxDepth": 4, "stepSize": 0.3, "maxIter": 6}
RF = {"name": "rf", "type": "rf", "numTrees": 5, "maxDepth": None, "minInstancesPerNode": 2, "minSplit": 6}
NAMES = [f"f{i}" for i in range(7)]


def table(n=400, seed=3):
    r = np.random.default_rng(seed)
    x = np.stack([r.integers(0, 5, n), r.integers(0, 2, n), r.integers(-3, 40, n), np.round(r.normal(size=n), 1),
                  r.integers(0, 3, n) / 2, np.full(n, 7.0), np.round(r.random(n), 2)], axis=1).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 0.2) ^ (r.random(n) < 0.15)).astype(int)
    return x, y


def frame(spark, x, y, parts=5):
    rows = [(int(i), int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "key long, label int, " + ", ".join(f"{f} double" for f in NAMES)).repartition(parts)


def row_ids(spark, n):
    return np.array([r[0] for r in spark.range(n).select(F.xxhash64("id"), "id").orderBy("id").collect()],
                    np.int64).view(np.uint64)


def split_of(rule, key, x, g, h, rows):
    """Best (gain, feature, left rows) of a node by trying every value of every column as a threshold."""
    columns = rule.columns
    if rule.per_node:
        by_hash = T._feature_order(np.array([key]), x.shape[1])[0]
        several = [f for f in columns if len({x[i, f] for i in rows}) > 1]
        columns = sorted(sorted(several, key=lambda f: by_hash[f])[:rule.per_node])
    best = None
    sg, sh = sum(int(g[i]) for i in rows), sum(int(h[i]) for i in rows)
    for f in columns:
        for v in sorted({x[i, f] for i in rows})[:-1]:
            left = [i for i in rows if x[i, f] <= v]
            if min(len(left), len(rows) - len(left)) < max(rule.min_leaf, 1):
                continue
            gl, hl = sum(int(g[i]) for i in left) / T.SCALE, sum(int(h[i]) for i in left) / T.SCALE
            gt, ht = sg / T.SCALE, sh / T.SCALE
            if min(hl, ht - hl) < rule.min_child_weight:
                continue
            gain = T.gains(gl, hl, gt, ht, rule.lam)
            if best is None or gain > best[0]:
                best = (gain, f, left)
    return best, sg, sh


def plain_tree(rule, x, g, h, rows, key, depth=0):
    """Nested (feature, left tree, right tree) or a leaf value."""
    best, sg, sh = split_of(rule, key, x, g, h, rows)
    stop = (len(rows) < rule.min_split or len(rows) < 2 * rule.min_leaf or depth >= rule.max_depth
            or (rule.kind == "rf" and not 0 < sg < sh))
    if stop or best is None or best[0] <= rule.least_gain:
        return float(rule.value(sg, sh))
    a, b = T._child_keys(np.array([key]))
    left = set(best[2])
    return (best[1], plain_tree(rule, x, g, h, best[2], a, depth + 1),
            plain_tree(rule, x, g, h, [i for i in rows if i not in left], b, depth + 1), left)


def nested(tree, cuts, node=0):
    if not tree["left"][node]:
        return tree["value"][node]
    left = tree["left"][node]
    return int(tree["feature"][node]), nested(tree, cuts, left), nested(tree, cuts, left + 1)


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return abs(a - b) < 1e-9
    return a[0] == b[0] and same(a[1], b[1]) and same(a[2], b[2])


def arrays(ensemble):
    return [t for g in ensemble.groups() for t in g]


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = table()
    return x, y, T.fit([GBT, RF], frame(spark, x, y), NAMES, "label", ["key"])


@pytest.mark.parametrize("cand", [GBT, RF], ids=["gbt", "rf"])
def test_equals_a_plain_trainer(spark, fitted, cand):
    x, y, models = fitted
    ids, margin = row_ids(spark, len(y)), np.zeros(len(y))
    got = arrays(models[cand["name"]])
    plan = T.rules(cand, len(NAMES), (int((y == 0).sum()), int((y == 1).sum())), 42)
    assert len(got) == len(plan)
    for rule, tree in zip(plan, got):
        if cand["type"] == "rf":
            times = T.multiplicity(ids, rule.seed, rule.tree)
            n = [times[y == c].sum() for c in (0, 1)]
            rule.weights = tuple(sum(n) / (2 * c) for c in n)
            h = np.array([int(np.rint(rule.weights[c] * T.SCALE)) * int(t) for c, t in zip(y, times)])
            g, rows = h * y, np.flatnonzero(times).tolist()
        else:
            p = np.array([1 / (1 + math.exp(-m)) for m in margin])
            w = np.where(y == 1, rule.weights[1], 1.0)
            g, h = np.rint(w * (p - y) * T.SCALE).astype(np.int64), np.rint(w * p * (1 - p) * T.SCALE).astype(np.int64)
            rows = np.flatnonzero(T._uniform(ids, rule.seed, rule.tree) < 0.8).tolist()
        assert same(nested(tree, None), plain_tree(rule, x, g, h, rows, T._root_key(rule.seed, rule.tree)))
        margin = margin + T.predict([tree], x)


@pytest.mark.parametrize("task_rows", [150, 20])
def test_node_by_node_equals_whole_units(spark, fitted, task_rows):
    """Nodes split by Spark jobs until 150 or 20 rows are left, other blocks: the same trees."""
    x, y, models = fitted
    other = T.fit([{**GBT, "maxIter": 2}, {**RF, "numTrees": 2}], frame(spark, x, y, parts=3), NAMES, "label", ["key"],
                  task_rows=task_rows)
    for name in ("gbt", "rf"):
        for a, b in zip(arrays(other[name]), arrays(models[name])):
            assert same(nested(a, None), nested(b, None))


def test_forest_grows_beyond_thirty_levels():
    """Without a limit a tree is as deep as its data: one row leaves at each level."""
    n = 200
    bins = np.arange(n, dtype=np.uint8)[:, None]
    y = np.arange(n) % 2
    rule = T.Rule("rf", 0, 1, min_leaf=1, min_split=2, columns=[0])
    # weights that double make the cut next to the last row the best one
    h = np.array([1 << min(i // 4, 50) for i in range(n)], np.int64)
    tree = T.grow(rule, bins, h * y, h, np.uint64(1))
    depth = {0: 0}
    for i, left in enumerate(tree["left"].tolist()):
        if left:
            depth[left] = depth[left + 1] = depth[i] + 1
    assert max(depth.values()) > 30
    assert all(tree["g"][i] in (0, tree["h"][i]) for i in np.flatnonzero(tree["left"] == 0))


def test_bins_of_many_values(spark):
    df = spark.range(5000).selectExpr("cast(id * id as double) as a", "cast(id % 3 as double) as b", "cast(1 as double) as c")
    cuts = T.cut_points(df, ["a", "b", "c"], bins=16)
    assert [len(c) for c in cuts] == [15, 2, 0] and cuts[1] == [0.5, 1.5]
    x = np.array([[float(i * i)] for i in range(5000)])
    sizes = np.bincount(T.binned(x, cuts[:1])[:, 0])
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1


def test_scores_and_round_trip(spark, fitted, tmp_path):
    x, y, models = fitted
    rows = frame(spark, x, y)
    for m in models.values():
        m.save(str(tmp_path / m.kind))
        back = T.Ensemble.load(spark, str(tmp_path / m.kind))
        got = rows.select("key", m.probability([F.col(f) for f in NAMES]).alias("p"),
                          back.probability([F.col(f) for f in NAMES]).alias("q")).orderBy("key").collect()
        raw = T.predict(arrays(m), x)
        want = 1 / (1 + np.exp(-raw)) if m.kind == "gbt" else raw / m.size
        assert all(r.p == r.q for r in got) and np.allclose([r.p for r in got], want, atol=1e-12)
        assert abs(sum(m.importances().values()) - 1) < 1e-9 and m.importances()["f5"] == 0
        small = [t for g in m.groups(most=200) for t in g]      # several broadcasts, the same trees in order
        assert [len(t["left"]) for t in small] == [len(t["left"]) for t in arrays(m)]


def test_one_class_and_one_row(spark):
    x, y = table(30)
    for rows in (frame(spark, x, np.zeros(30, int)), frame(spark, x[:1], y[:1])):
        for m in T.fit([{**GBT, "maxIter": 2}, {**RF, "numTrees": 2}], rows, NAMES, "label", ["key"]).values():
            assert len(arrays(m)) == 2 and all(len(t["left"]) == 1 or m.kind == "gbt" for t in arrays(m))
