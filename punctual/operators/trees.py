"""Histogram tree ensembles fitted by Spark jobs: second-order boosting (L8) and class-balanced forests.

Both grow trees by the same rule.  Every row in a tree's bag has two additive
numbers, g and h.  A node's best split over (feature, bin) maximises

    GL^2 / (HL + lam) + GR^2 / (HR + lam) - G^2 / (H + lam).

* Boosting: g, h are gradient and hessian of the logistic loss, times the
  positive-class weight; bag and columns are drawn once for each tree; a leaf is
  ``-rate * G / (H + lam)``.
* Forest: h is the row's multiplicity in a Poisson(1) bootstrap times the class
  weight *of that draw* (n / (2 n_c) over the draw), g = h * label, lam = 0: the
  gain is the Gini decrease times half the weight.  Columns are drawn for each
  node; a leaf is G / H.  Without a depth limit nodes grow until pure or small.

g and h are fixed-point integers, so sums are exact: a tree depends neither on
how rows are dealt to tasks nor on their order, and a recomputed task gives the
same numbers.  All draws are hashes of row id, tree and node.

Scale.  Rows are packed into blocks of binned features (one byte for each), one
Arrow batch a block.  A node of more than ``task_rows`` rows is split by a
Spark job: tasks emit sums by (tree, node, feature, bin), partial aggregation
merges them, running sums over a feature's bins give the best split, and the
driver sees one row for each (node, feature).  A node of at most ``task_rows``
rows is sent whole to a task, which finishes its subtree.  Where the root is
such a node, the packed rows are broadcast, and a run of boosting rounds or a
few trees of a forest is one task.  Results are equal for every ``task_rows``
(tested).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from punctual.operators.common import prefix_sums
from punctual.session import fresh_path, ship_package

#: Bins of a feature (one byte each).
BINS = 256
#: Rows of a node that one task finishes.
TASK_ROWS = 1 << 20
#: Fixed-point steps of g and h.
SCALE = float(1 << 30)
#: Bytes of trees that one broadcast holds; a larger ensemble is scored by several.
GROUP_BYTES = 32 << 20
_NO_LIMIT = 1 << 30


# ---------------------------------------------------------------------------
# hashing: every draw is a function of row, tree and node
# ---------------------------------------------------------------------------
def _mix(x) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    return (_mix(ids ^ _mix(np.uint64(seed) * np.uint64(1 << 32) + np.uint64(tree))) >> np.uint64(11)) / float(1 << 53)


# P(multiplicity <= k) of Poisson(1)
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


def multiplicity(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn into the tree's bootstrap."""
    return np.searchsorted(_POISSON, _uniform(ids, seed, tree), side="right")


def _root_key(seed: int, tree: int) -> np.uint64:
    return _mix(np.uint64(seed) * np.uint64(1 << 32) + np.uint64(tree) + np.uint64(1 << 63))


def _child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of left and right children, interleaved."""
    keys = np.asarray(keys, np.uint64)
    return _mix(np.stack([keys, keys ^ np.uint64(0xFFFFFFFF)], axis=1)).reshape(-1)


def _feature_order(keys: np.ndarray, n_features: int) -> np.ndarray:
    """Hash of each (node, feature): nodes try features in its order."""
    return _mix(np.asarray(keys, np.uint64)[:, None] ^ _mix(np.arange(n_features, dtype=np.uint64))[None, :])


# ---------------------------------------------------------------------------
# one tree
# ---------------------------------------------------------------------------
@dataclass
class Rule:
    """How a tree draws and splits."""

    kind: str                    # "gbt" or "rf"
    tree: int
    seed: int
    max_depth: int = _NO_LIMIT
    rate: float = 1.0
    lam: float = 0.0
    min_child_weight: float = 0.0
    min_leaf: int = 1
    min_split: int = 2
    columns: list[int] = field(default_factory=list)      # columns of the tree
    per_node: int = 0                                     # columns of a node; 0: all of the tree's
    weights: tuple[float, float] = (1.0, 1.0)             # of labels 0 and 1

    def bag(self, ids: np.ndarray, y: np.ndarray, margin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows in the bag, g, h)."""
        if self.kind == "gbt":
            rows = np.flatnonzero(_uniform(ids, self.seed, self.tree) < 0.8)
            p = 1.0 / (1.0 + np.exp(-margin[rows]))
            w = np.where(y[rows] == 1, self.weights[1], self.weights[0])
            return rows, np.rint(w * (p - y[rows]) * SCALE).astype(np.int64), \
                np.rint(w * np.maximum(p * (1.0 - p), 1e-9) * SCALE).astype(np.int64)
        times = multiplicity(ids, self.seed, self.tree)
        rows = np.flatnonzero(times)
        fixed = np.rint(np.array(self.weights) * SCALE).astype(np.int64)
        h = fixed[y[rows].astype(np.int64)] * times[rows]
        return rows, h * y[rows], h

    def value(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        g, h = np.asarray(g) / SCALE, np.asarray(h) / SCALE
        if self.kind == "gbt":
            return -self.rate * g / (h + self.lam)
        return np.where(h > 0, g / np.where(h > 0, h, 1.0), 0.0)

    def may_split(self, g, h, n, depth: int) -> np.ndarray:
        g, h, n = np.asarray(g), np.asarray(h), np.asarray(n)
        ok = (n >= self.min_split) & (n >= 2 * self.min_leaf) & (depth < self.max_depth)
        return ok & (g > 0) & (g < h) if self.kind == "rf" else ok

    @property
    def least_gain(self) -> float:
        return 1e-6 if self.kind == "gbt" else -1e-12


def gains(gl, hl, g, h, lam: float):
    """Gain of a split with left sums gl, hl of node sums g, h (all as real numbers)."""
    gr, hr = g - gl, h - hl
    return gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam)


class Nodes:
    """Nodes of a growing tree; a child pair is adjacent, so ``left`` tells both (0: leaf)."""

    def __init__(self):
        self.feature, self.cut, self.left, self.g, self.h, self.gain = [], [], [], [], [], []

    def add(self, g: int, h: int) -> int:
        for column, v in zip((self.feature, self.cut, self.left, self.g, self.h, self.gain), (-1, 0, 0, int(g), int(h), 0.0)):
            column.append(v)
        return len(self.left) - 1

    def split(self, node: int, feature: int, cut: int, gain: float, sums: tuple) -> int:
        """Children with the sums (gl, hl, gr, hr); returns the left one."""
        left = self.add(*sums[:2])
        self.add(*sums[2:])
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, left, gain
        return left

    def graft(self, node: int, sub: dict) -> None:
        """Puts a finished subtree in place of the leaf ``node``."""
        at = len(self.left)
        place = np.concatenate([[node], at + np.arange(len(sub["left"]) - 1)])
        for i in range(1, len(sub["left"])):
            self.add(0, 0)
        for name in ("feature", "cut", "g", "h", "gain"):
            column = getattr(self, name)
            for i, v in zip(place.tolist(), sub[name].tolist()):
                column[i] = v
        for i, v in zip(place.tolist(), sub["left"].tolist()):
            self.left[i] = int(place[v]) if v else 0

    def arrays(self) -> dict:
        return {"feature": np.array(self.feature, np.int8), "cut": np.array(self.cut, np.uint8),
                "left": np.array(self.left, np.int32), "g": np.array(self.g, np.int64),
                "h": np.array(self.h, np.int64), "gain": np.array(self.gain, np.float64)}


def leaves_of(tree: dict, bins: np.ndarray, start: int = 0) -> np.ndarray:
    """Node of each row that has no child (of the tree as it stands)."""
    at = np.full(len(bins), start, np.int64)
    rows = np.arange(len(bins))
    while True:
        left = tree["left"][at]
        inner = np.flatnonzero(left)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = left[inner] + (bins[rows[inner], tree["feature"][node]] > tree["cut"][node])


def grow(rule: Rule, bins: np.ndarray, g: np.ndarray, h: np.ndarray, key: np.uint64, depth: int = 0) -> dict:
    """A (sub)tree over the rows of one task, level by level; all nodes of a level at once.  ``at``: each row's leaf
    (boosting only)."""
    # in real units sums stay exact: steps are powers of two
    rows = (_DrawnColumns if rule.per_node else _SummedRows)(rule, bins, g / SCALE, h / SCALE)
    levels, count = [], 1
    keys, sizes = np.array([key], np.uint64), np.array([len(g)])
    gs, hs = np.array([g.sum()]), np.array([h.sum()])
    while True:
        m = len(sizes)
        level = {"feature": np.full(m, -1, np.int8), "cut": np.zeros(m, np.uint8), "left": np.zeros(m, np.int32),
                 "g": gs.astype(np.int64), "h": hs.astype(np.int64), "gain": np.zeros(m)}
        levels.append(level)
        go = np.flatnonzero(rule.may_split(gs, hs, sizes, depth))
        if not len(go):
            break
        gain, feature, cut, gl, hl = rows.best(go, gs[go] / SCALE, hs[go] / SCALE, keys[go])
        done = np.flatnonzero(gain > rule.least_gain)
        if not len(done):
            break
        gl, hl = (gl[done] * SCALE).astype(np.int64), (hl[done] * SCALE).astype(np.int64)
        split = go[done]
        level["feature"][split], level["cut"][split], level["gain"][split] = feature[done], cut[done], gain[done]
        level["left"][split] = count + 2 * np.arange(len(split))
        sizes = rows.divide(done, feature[done], cut[done], count)
        count += 2 * len(split)
        gs, hs = (np.stack([left, whole[split] - left], axis=1).reshape(-1) for left, whole in ((gl, gs), (hl, hs)))
        keys, depth = _child_keys(keys[split]), depth + 1
    tree = {c: np.concatenate([level[c] for level in levels]) for c in levels[0]}
    return {**tree, "at": rows.at}


class _SummedRows:
    """Rows of a tree all of whose nodes may use the same columns: sums by (node, column, bin), columns side by side.

    Of two children only the one of fewer rows is summed; the other's sums are the parent's less these (exact)."""

    def __init__(self, rule: Rule, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        self.rule, self.columns = rule, np.array(rule.columns)
        self.flat, self.n_features = np.ascontiguousarray(bins).reshape(-1), bins.shape[1]
        self.column = np.ascontiguousarray(bins[:, self.columns].T)
        wide = self.column.max(axis=1, initial=0).astype(np.int64) + 1
        self.first, self.column_of = np.concatenate([[0], np.cumsum(wide)]), np.repeat(np.arange(len(wide)), wide)
        self.g, self.h = g, h
        self.counted = rule.min_leaf > 1 or rule.min_child_weight <= 0
        self.rows, self.slot, self.sizes = np.arange(len(g)), np.zeros(len(g), np.int64), np.array([len(g)])
        self.at, self.sums, self.parent = np.zeros(len(g), np.int64), None, None

    def _summed(self, rows: np.ndarray, slot: np.ndarray, m: int) -> np.ndarray:
        out = np.empty((3 if self.counted else 2, m, self.first[-1]))
        whole = len(rows) == len(self.g)
        g, h = (self.g, self.h) if whole else (self.g[rows], self.h[rows])
        for j, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist())):
            cell = slot * (b - a) + (self.column[j] if whole else self.column[j][rows])
            out[0, :, a:b] = np.bincount(cell, g, m * (b - a)).reshape(m, -1)
            out[1, :, a:b] = np.bincount(cell, h, m * (b - a)).reshape(m, -1)
            if self.counted:
                out[2, :, a:b] = np.bincount(cell, minlength=m * (b - a)).reshape(m, -1)
        return out

    def best(self, go, gs, hs, keys):
        m = len(self.sizes)
        if self.parent is None:
            self.sums = self._summed(self.rows, self.slot, m)
        else:
            pairs = self.sizes.reshape(-1, 2)
            fewer = (pairs[:, 1] < pairs[:, 0]).astype(np.int64)         # which child of each pair
            pair = self.slot >> 1
            here = np.flatnonzero((self.slot & 1) == fewer[pair])
            less = self._summed(self.rows[here], pair[here], len(pairs))
            self.sums = np.empty((len(less), m, less.shape[2]))
            at = 2 * np.arange(len(pairs)) + fewer
            self.sums[:, at], self.sums[:, at ^ 1] = less, self.parent - less
        self.sums = self.sums[:, go]
        left = np.empty_like(self.sums)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            np.cumsum(self.sums[:, :, a:b], axis=2, out=left[:, :, a:b])
        found = _judge(self.rule, left[0], left[1], left[2] if self.counted else None, gs[:, None], hs[:, None],
                       self.sizes[go][:, None])
        self.go = go
        pick, rows = found.argmax(axis=1), np.arange(len(go))
        j = self.column_of[pick]
        return found[rows, pick], self.columns[j], pick - self.first[j], left[0][rows, pick], left[1][rows, pick]

    def divide(self, done, feature, cut, count: int) -> np.ndarray:
        """Rows of each child of the nodes ``go[done]``; children are numbered from ``count``."""
        place = np.full(len(self.sizes), -1)
        place[self.go[done]] = np.arange(len(done))
        slot = place[self.slot]
        if len(done) < len(self.sizes):
            keep = np.flatnonzero(slot >= 0)
            self.rows, slot = self.rows[keep], slot[keep]
        self.slot = 2 * slot + (self.flat[self.rows * self.n_features + feature[slot]] > cut[slot])
        self.at[self.rows] = count + self.slot
        self.parent = self.sums[:, done]
        self.sizes = np.bincount(self.slot, minlength=2 * len(done))
        return self.sizes


class _DrawnColumns:
    """Rows of a tree whose nodes draw ``per_node`` of the columns that vary in them; they lie in the order of the nodes.

    Each node tries columns in the order of their hashes until enough of them vary.  While nodes hold more rows than
    their columns have bins, sums are taken by (node, bin); after that rows are sorted by them, so that the work is that
    of the rows, not of the bins."""

    at = None

    def __init__(self, rule: Rule, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        if len(g) >> 28:
            raise ValueError("a task holds less than 2^28 rows")
        self.rule, self.bins, self.g, self.h, self.sizes = rule, np.ascontiguousarray(bins), g, h, np.array([len(g)])
        self.wide = bins.max(axis=0, initial=0).astype(np.int64) + 1

    def _take(self, rows: np.ndarray) -> None:
        self.bins, self.g, self.h = self.bins[rows], self.g[rows], self.h[rows]

    def _values(self, feature: np.ndarray, slot: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        start = np.arange(len(self.g)) if rows is None else rows
        return self.bins.reshape(-1)[start * self.bins.shape[1] + feature[slot]]

    def _tried(self, feature: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None):
        """The cuts of nodes by one column each, in the order of (node, bin): node, bin, left sums of g, h and rows; and
        which nodes it varies in.  Bins may be empty, but a cut next to an empty one never comes first."""
        slot = np.repeat(np.arange(len(feature)), sizes)
        value = self._values(feature, slot, rows)
        g, h = (self.g, self.h) if rows is None else (self.g[rows], self.h[rows])
        wide = self.wide[feature]
        starts = np.cumsum(wide) - wide
        if (cells := int(wide.sum())) <= len(slot):
            cell = starts[slot] + value
            n = np.bincount(cell, minlength=cells)
            varies = np.add.reduceat((n > 0).astype(np.int64), starts) > 1
            sums = [np.cumsum(v) for v in (np.bincount(cell, g, cells), np.bincount(cell, h, cells), n)]
            s = np.repeat(np.arange(len(feature)), wide)
            gl, hl, nl = (v - np.concatenate([[0], v[starts[1:] - 1]])[s] for v in sums)
            return s, np.arange(cells) - starts[s], gl, hl, nl, varies
        key = (((slot << 8) | value) << 28 | np.arange(len(slot))).view(np.uint64)
        key.sort()
        cell, order = (key >> np.uint64(28)).view(np.int64), (key & np.uint64((1 << 28) - 1)).view(np.int64)
        last = np.flatnonzero(cell[1:] != cell[:-1])                 # the last row of each bin
        s = cell[last] >> 8
        inside = np.flatnonzero(s == cell[last + 1] >> 8)            # but of a node's last bin
        last, s = last[inside], s[inside]
        ends = np.cumsum(sizes)
        gl, hl = (v[last] - np.concatenate([[0.0], v[ends[:-1] - 1]])[s] for v in (np.cumsum(g[order]), np.cumsum(h[order])))
        varies = np.zeros(len(feature), bool)
        varies[s] = True
        return s, cell[last] & 255, gl, hl, last + 1 - (ends - sizes)[s], varies

    def best(self, go, gs, hs, keys):
        if len(go) < len(self.sizes):
            goes = np.zeros(len(self.sizes), bool)
            goes[go] = True
            self._take(np.flatnonzero(np.repeat(goes, self.sizes)))
            self.sizes = self.sizes[go]
        m, n_features = len(go), self.bins.shape[1]
        order = np.argsort(_feature_order(keys, n_features), axis=1, kind="stable")
        gain, feature, cut, gl, hl = (np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m))
        need, varied = np.arange(m), np.zeros(m, np.int64)
        for p in range(n_features):
            rows = None
            if len(need) < m:
                needs = np.zeros(m, bool)
                needs[need] = True
                rows = np.flatnonzero(np.repeat(needs, self.sizes))
            tried = order[need, p]
            s, bin_, *left, varies = self._tried(tried, self.sizes[need], rows)
            if len(s):
                node = need[s]
                found = _judge(self.rule, *left, gs[node], hs[node], self.sizes[node])
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                top = np.maximum.reduceat(found, first)
                most = np.flatnonzero(found == np.repeat(top, np.diff(np.append(first, len(s)))))
                most = most[np.concatenate([[True], s[most][1:] != s[most][:-1]])]     # the lowest cut of equal ones
                node, f = node[first], tried[s[first]]
                better = np.flatnonzero((top > gain[node]) | ((top == gain[node]) & (f < feature[node])))
                node, most = node[better], most[better]
                gain[node], feature[node], cut[node] = top[better], f[better], bin_[most]
                gl[node], hl[node] = left[0][most], left[1][most]
            varied[need] += varies
            need = need[varied[need] < self.rule.per_node]
            if not len(need):
                break
        return gain, feature, cut, gl, hl

    def divide(self, done, feature, cut, count: int) -> np.ndarray:
        """Rows of each child of the nodes ``go[done]``; brings the rows into the order of the children."""
        if len(done) < len(self.sizes):
            split = np.zeros(len(self.sizes), bool)
            split[done] = True
            self._take(np.flatnonzero(np.repeat(split, self.sizes)))
        sizes = self.sizes[done]
        slot = np.repeat(np.arange(len(done)), sizes)
        right = self._values(feature, slot, None) > cut[slot]
        n_right = np.bincount(slot[right], minlength=len(done))
        n_left = sizes - n_right
        to = np.empty(len(slot), np.int64)
        for goes, earlier in ((np.flatnonzero(~right), np.cumsum(n_right) - n_right), (np.flatnonzero(right), np.cumsum(n_left))):
            to[np.arange(len(goes)) + earlier[slot[goes]]] = goes
        self._take(to)
        self.sizes = np.stack([n_left, n_right], axis=1).reshape(-1)
        return self.sizes


def _judge(rule: Rule, gl, hl, nl, g, h, n) -> np.ndarray:
    """Gains of splits by their left sums (real units); -inf where a side is too small."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gains(gl, hl, g, h, rule.lam)
    ok = (hl >= rule.min_child_weight) & (h - hl >= rule.min_child_weight)
    if nl is not None:
        least = max(rule.min_leaf, 1)
        ok &= (nl >= least) & (n - nl >= least)
    gain[~ok] = -np.inf
    return gain


# ---------------------------------------------------------------------------
# binned rows
# ---------------------------------------------------------------------------
def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Per feature, the cuts between its bins: midway between neighbouring values where they fit into ``bins``,
    else between quantiles.  One stacked value count; at most ``bins`` rows a feature reach the driver."""
    pairs = ", ".join(f"{i}, cast(`{f}` as double)" for i, f in enumerate(features))
    counts = rows.selectExpr(f"stack({len(features)}, {pairs}) as (feature, value)").groupBy("feature", "value") \
        .agg(F.count(F.lit(1)).alias("cnt")).withColumn("one", F.lit(1).cast("long"))
    whole = counts.groupBy("feature").agg(F.sum("cnt").alias("n"), F.sum("one").alias("values"))
    ranked = prefix_sums(counts, ["feature", "value"], ["cnt", "one"], ("feature",)).join(whole, "feature")
    by_rank = F.col("cum_one") - 1
    by_share = F.floor((F.col("cum_cnt") - F.col("cnt")) * bins / F.col("n"))
    found = (ranked.withColumn("bin", F.when(F.col("values") <= bins, by_rank).otherwise(by_share))
             .groupBy("feature", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
             .orderBy("feature", "bin").collect())
    cuts: list[list[float]] = [[] for _ in features]
    for a, b in zip(found, found[1:]):
        if a["feature"] == b["feature"]:
            cuts[a["feature"]].append((a["hi"] + b["lo"]) / 2.0)
    return cuts


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(c, float), x[:, i], side="left") for i, c in enumerate(cuts)],
                    axis=1).astype(np.uint8)


def blocks_of(rows: DataFrame, features: list[str], label: str, key: list[str], cuts: list[list[float]]) -> DataFrame:
    """``rows`` packed: n, bins, y, id, margin (empty); a block for each Arrow batch, written to the shared folder."""
    spark = rows.sparkSession
    ship_package(spark)
    schema = pa.schema([("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("id", pa.binary()),
                        ("margin", pa.binary())])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32())] + [
                    pa.array([v], pa.binary()) for v in (binned(x, cuts).tobytes(), y.tobytes(), ids.tobytes(), b"")],
                    schema=schema)
    flat = rows.select(F.xxhash64(*key).alias("id"), F.col(label).cast("int").alias("y"),
                       *[F.col(f).cast("double") for f in features])
    return _written(flat.mapInArrow(pack, "n int, bins binary, y binary, id binary, margin binary"), "blocks")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, f"trees/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unpacked(row: dict, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(row["y"], np.uint8)
    margin = np.frombuffer(row["margin"], np.float64) if row["margin"] else np.zeros(len(y))
    return (np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features), y,
            np.frombuffer(row["id"], np.int64).view(np.uint64), margin)


# ---------------------------------------------------------------------------
# candidates
# ---------------------------------------------------------------------------
def rules(cand: dict, n_features: int, counts: tuple[int, int], seed: int) -> list[Rule]:
    """The trees of a candidate; ``counts`` are the rows of labels 0 and 1."""
    if cand["type"] == "gbt":
        weight = counts[0] / max(counts[1], 1)
        out = []
        for t in range(cand["maxIter"]):
            order = np.argsort(_feature_order(np.array([_root_key(seed, t)]), n_features)[0])
            columns = sorted(order[:max(1, int(0.8 * n_features))].tolist())
            out.append(Rule("gbt", t, seed, cand["maxDepth"], cand["stepSize"], lam=1.0, min_child_weight=1.0,
                            columns=columns, weights=(1.0, weight)))
        return out
    if cand["type"] == "rf":
        return [Rule("rf", t, seed, cand["maxDepth"] or _NO_LIMIT, min_leaf=cand["minInstancesPerNode"],
                     min_split=cand.get("minSplit", 10), columns=list(range(n_features)),
                     per_node=max(1, int(n_features ** 0.5))) for t in range(cand["numTrees"])]
    raise ValueError(f"unknown candidate type {cand['type']}")


def _draw_weights(times: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Drawn rows of labels 0 and 1."""
    return np.array([times[y == 0].sum(), times[y == 1].sum()], np.int64)


def _balanced(drawn: np.ndarray) -> tuple[float, float]:
    n = drawn.sum()
    return tuple(float(n / (2.0 * c)) if c else 0.0 for c in drawn.tolist())


def _with_weights(rule: Rule, drawn: np.ndarray) -> Rule:
    return Rule(**{**rule.__dict__, "weights": _balanced(drawn)})


def _finished(rule: Rule, tree: dict) -> dict:
    return {"tree": rule.tree, "feature": tree["feature"], "cut": tree["cut"], "left": tree["left"],
            "value": rule.value(tree["g"], tree["h"]), "cover": tree["h"] / SCALE, "gain": tree["gain"]}


def run_here(rules_: list[Rule], bins: np.ndarray, y: np.ndarray, ids: np.ndarray, margin: np.ndarray) -> Iterator[dict]:
    """The trees of ``rules_`` over rows that one task holds."""
    for rule in rules_:
        if rule.kind == "rf":
            rule = _with_weights(rule, _draw_weights(multiplicity(ids, rule.seed, rule.tree), y))
        rows, g, h = rule.bag(ids, y, margin)
        tree = grow(rule, bins[rows], g, h, _root_key(rule.seed, rule.tree))
        out = _finished(rule, tree)
        if rule.kind == "gbt":
            outside = np.ones(len(y), bool)
            outside[rows] = False
            outside = np.flatnonzero(outside)
            moved = np.empty(len(y))
            moved[rows], moved[outside] = out["value"][tree["at"]], out["value"][leaves_of(tree, bins[outside])]
            margin = margin + moved
        yield out


_TREE_DDL = "unit string, tree int, feature binary, cut binary, `left` binary, value binary, cover binary, gain binary"
_TREE_ARROW = pa.schema([("unit", pa.string()), ("tree", pa.int32())] + [(c, pa.binary()) for c in (
    "feature", "cut", "left", "value", "cover", "gain")])
_PARTS = (("feature", np.int8), ("cut", np.uint8), ("left", np.int32), ("value", np.float64), ("cover", np.float64),
          ("gain", np.float64))
#: Forest trees of one unit of work.
_TREES_A_TASK = 8


def _tree_batch(unit: str, trees: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([unit] * len(trees), pa.string()), pa.array([t["tree"] for t in trees], pa.int32())]
        + [pa.array([np.ascontiguousarray(t[c], d).tobytes() for t in trees], pa.binary()) for c, d in _PARTS],
        schema=_TREE_ARROW)


def fit(cands: list[dict], rows: DataFrame, features: list[str], label: str, key: list[str], seed: int = 42,
        task_rows: int = TASK_ROWS) -> dict[str, "Ensemble"]:
    """An ensemble for each candidate, by name; ``rows`` has the features as numbers, the label 0/1 and a row key.

    The rows are packed once.  Where all of them are at most ``task_rows``, every boosting run and every few trees of
    a forest is a unit of work of one task; otherwise nodes are split by Spark jobs until they are that small."""
    spark = rows.sparkSession
    cuts = cut_points(rows, features)
    blocks = blocks_of(rows, features, label, key, cuts)
    n_features = len(features)
    counts = rows.groupBy(label).count().collect()                       # two rows
    of = {int(r[label]): r["count"] for r in counts}
    counts = (of.get(0, 0), of.get(1, 0))
    plans = {c["name"]: rules(c, n_features, counts, seed) for c in cands}
    if sum(counts) <= task_rows:
        trees = _whole_units(blocks, plans, n_features)
    else:
        trees = _by_nodes(blocks, plans, n_features, task_rows)
    trees = _written(trees, "ensembles")
    return {c["name"]: Ensemble(c["type"], features, cuts, trees.where(F.col("unit") == c["name"]), len(plans[c["name"]]))
            for c in cands}


def _whole_units(blocks: DataFrame, plans: dict[str, list[Rule]], n_features: int) -> DataFrame:
    spark, units = blocks.sparkSession, []
    for name, plan in plans.items():
        step = len(plan) if plan and plan[0].kind == "gbt" else _TREES_A_TASK
        units += [(name, plan[a:a + step]) for a in range(0, len(plan), step)]
    parts = [_unpacked(r.asDict(), n_features)[:3] for r in blocks.collect()]    # at most task_rows rows, a few bytes each
    if not parts or not units:
        return spark.createDataFrame([], _TREE_DDL)
    held = spark.sparkContext.broadcast(tuple(np.concatenate(p) for p in zip(*parts)))

    def train(batches):
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                name, plan = units[unit]
                bins, y, ids = held.value
                for t in run_here(plan, bins, y, ids, np.zeros(len(y))):
                    yield _tree_batch(name, [t])
    return spark.range(0, len(units), 1, len(units)).mapInArrow(train, _TREE_DDL)


# ---------------------------------------------------------------------------
# node by node: nodes beyond one task
# ---------------------------------------------------------------------------
_STATE = tuple[Rule, dict]                   # a rule and its tree as it stands


def _sums(blocks: DataFrame, state: list[_STATE], wanted: list[set[int]], n_features: int) -> DataFrame:
    """tree, node, feature, bin, g, h, n: sums over the rows of the wanted nodes, merged by Spark."""
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()),
                        ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, ids, margin = _unpacked(row, n_features)
                for i, ((rule, tree), nodes) in enumerate(zip(state, wanted)):
                    rows, g, h = rule.bag(ids, y, margin)
                    at = leaves_of(tree, bins[rows])
                    here = np.isin(at, list(nodes))
                    rows, g, h, at = rows[here], g[here], h[here], at[here]
                    if not len(rows):
                        continue
                    names, slot = np.unique(at, return_inverse=True)
                    for f in rule.columns:
                        cell = slot * BINS + bins[rows, f]
                        n = np.bincount(cell, minlength=len(names) * BINS)
                        full = np.flatnonzero(n)
                        gs, hs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                        np.add.at(gs, cell, g)
                        np.add.at(hs, cell, h)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(full), i), pa.int32()), pa.array(names[full // BINS], pa.int32()),
                             pa.array(np.full(len(full), f), pa.int32()), pa.array(full % BINS, pa.int32()),
                             pa.array(gs[full]), pa.array(hs[full]), pa.array(n[full], pa.int64())], schema=schema)
    out = blocks.mapInArrow(run, "tree int, node int, feature int, bin int, g long, h long, n long")
    return out.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def _best_splits(sums: DataFrame, rule: Rule) -> list[dict]:
    """Per (tree, node, feature): number of bins, sums, and the best split by running sums over the bins."""
    group = Window.partitionBy("tree", "node", "feature")
    so_far = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = sums.select("tree", "node", "feature", "bin", *[F.sum(c).over(so_far).alias(f"{c}l") for c in "ghn"],
                      *[F.sum(c).over(group).alias(c) for c in "ghn"], F.count(F.lit(1)).over(group).alias("bins"))

    def real(c: str) -> Column:
        return F.col(c) / F.lit(SCALE)
    gain = gains(real("gl"), real("hl"), real("g"), real("h"), F.lit(rule.lam))
    least = F.lit(max(rule.min_leaf, 1))
    ok = (F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least) & (real("hl") >= rule.min_child_weight) \
        & ((F.col("h") - F.col("hl")) / F.lit(SCALE) >= rule.min_child_weight)
    best = F.max(F.when(ok, F.struct(gain.alias("gain"), (-F.col("bin")).alias("cut"), "gl", "hl", "nl")))
    rows = cum.groupBy("tree", "node", "feature", "bins", "g", "h", "n").agg(best.alias("best")).collect()
    return [r.asDict(recursive=True) for r in rows]          # a row for each large node and feature


def _finish_small(blocks: DataFrame, state: list[_STATE], small: list[dict[int, tuple]], n_features: int) -> dict:
    """Subtrees of the small nodes: their rows go to one task each."""
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("rows", pa.binary()), ("g", pa.binary()), ("h", pa.binary())])

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, ids, margin = _unpacked(row, n_features)
                for i, ((rule, tree), nodes) in enumerate(zip(state, small)):
                    rows, g, h = rule.bag(ids, y, margin)
                    at = leaves_of(tree, bins[rows])
                    for node in np.intersect1d(at, list(nodes)).tolist():
                        here = at == node
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([node], pa.int32())] + [
                            pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                            for v in (bins[rows[here]], g[here], h[here])], schema=schema)

    names = ("feature", "cut", "left", "g", "h", "gain")
    types = {"feature": np.int8, "cut": np.uint8, "left": np.int32, "g": np.int64, "h": np.int64, "gain": np.float64}
    out_schema = pa.schema([("tree", pa.int32()), ("node", pa.int32())] + [(c, pa.binary()) for c in names])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        i, node = rows[0]["tree"], rows[0]["node"]
        key, depth = small[i][node]
        bins = np.concatenate([np.frombuffer(r["rows"], np.uint8).reshape(-1, n_features) for r in rows])
        g, h = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in "gh")
        sub = grow(state[i][0], bins, g, h, key, depth)
        return pa.Table.from_arrays([pa.array([i], pa.int32()), pa.array([node], pa.int32())]
                                    + [pa.array([sub[c].tobytes()], pa.binary()) for c in names], schema=out_schema)
    dealt = blocks.mapInArrow(deal, "tree int, node int, rows binary, g binary, h binary")
    found = dealt.groupBy("tree", "node").applyInArrow(finish, "tree int, node int, " + ", ".join(f"`{c}` binary" for c in names))
    return {(r["tree"], r["node"]): {c: np.frombuffer(r[c], types[c]) for c in names} for r in found.collect()}


def _grown(blocks: DataFrame, plan: list[Rule], n_features: int, rows: int, task_rows: int) -> list[dict]:
    """The trees of ``plan`` (of one kind, over the same margins), level by level."""
    trees = [Nodes() for _ in plan]
    keys = [{0: (_root_key(r.seed, r.tree), 0)} for r in plan]
    for t in trees:
        t.add(0, 0)
    open_ = [{0} if rows > task_rows else set() for _ in plan]
    small: list[dict] = [{} if rows > task_rows else {0: keys[i][0]} for i in range(len(plan))]
    while any(open_):
        state = [(r, t.arrays()) for r, t in zip(plan, trees)]
        found: dict[tuple, list[dict]] = {}
        for r in _best_splits(_sums(blocks, state, open_, n_features), plan[0]):
            found.setdefault((r["tree"], r["node"]), []).append(r)
        open_ = [set() for _ in plan]
        for (i, node), per_feature in found.items():
            rule, tree, (key, depth) = plan[i], trees[i], keys[i][node]
            g, h, n = (per_feature[0][c] for c in "ghn")
            tree.g[node], tree.h[node] = g, h
            if not rule.may_split(g, h, n, depth):
                continue
            if rule.per_node:
                hashed = _feature_order(np.array([key]), n_features)[0]
                several = sorted((p for p in per_feature if p["bins"] > 1), key=lambda p: hashed[p["feature"]])
                per_feature = several[:rule.per_node]
            best = max((p for p in per_feature if p["best"]), default=None,
                       key=lambda p: (p["best"]["gain"], -p["feature"]))
            if best is None or best["best"]["gain"] <= rule.least_gain:
                continue
            b = best["best"]
            left = tree.split(node, best["feature"], -b["cut"], b["gain"], (b["gl"], b["hl"], g - b["gl"], h - b["hl"]))
            for c, child_key, size in zip((left, left + 1), _child_keys(np.array([key])), (b["nl"], n - b["nl"])):
                keys[i][c] = (child_key, depth + 1)
                if size > task_rows:
                    open_[i].add(c)
                else:
                    small[i][c] = keys[i][c]
    if any(small):
        state = [(r, t.arrays()) for r, t in zip(plan, trees)]
        for (i, node), sub in _finish_small(blocks, state, small, n_features).items():
            trees[i].graft(node, sub)
    return [t.arrays() for t in trees]


def _moved(blocks: DataFrame, tree: dict, n_features: int) -> DataFrame:
    """``blocks`` with the tree's values added to the margins, written."""
    schema = pa.schema([("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("id", pa.binary()),
                        ("margin", pa.binary())])

    def run(batches):
        for batch in batches:
            out = [(r["n"], r["bins"], r["y"], r["id"], (m + tree["value"][leaves_of(tree, b)]).tobytes())
                   for r in batch.to_pylist() for b, _, _, m in [_unpacked(r, n_features)]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return _written(blocks.mapInArrow(run, "n int, bins binary, y binary, id binary, margin binary"), "margins")


def _drawn(blocks: DataFrame, plan: list[Rule], n_features: int) -> list[Rule]:
    """Forest rules with the class weights of their draws."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, y, ids, _ = _unpacked(row, n_features)
                drawn = [_draw_weights(multiplicity(ids, r.seed, r.tree), y) for r in plan]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(plan)), pa.int32()),
                                                  pa.array([int(d[0]) for d in drawn], pa.int64()),
                                                  pa.array([int(d[1]) for d in drawn], pa.int64())], names=["i", "zero", "one"])
    rows = blocks.mapInArrow(run, "i int, zero long, one long").groupBy("i").agg(F.sum("zero").alias("zero"),
                                                                                 F.sum("one").alias("one")).collect()
    drawn = {r["i"]: np.array([r["zero"], r["one"]]) for r in rows}
    return [_with_weights(r, drawn[i]) for i, r in enumerate(plan)]


def _by_nodes(blocks: DataFrame, plans: dict[str, list[Rule]], n_features: int, task_rows: int) -> DataFrame:
    spark, out = blocks.sparkSession, []
    rows = blocks.agg(F.sum("n")).first()[0]
    for name, plan in plans.items():
        trees = []
        if plan[0].kind == "gbt":
            now = blocks
            for rule in plan:
                grown = _grown(now, [rule], n_features, rows, task_rows)[0]
                done = _finished(rule, grown)
                trees.append(done)
                now = _moved(now, done, n_features)
        else:
            for a in range(0, len(plan), _TREES_A_TASK):
                some = _drawn(blocks, plan[a:a + _TREES_A_TASK], n_features)
                trees += [_finished(r, t) for r, t in zip(some, _grown(blocks, some, n_features, rows, task_rows))]
        out += [spark.createDataFrame(pa.Table.from_batches([_tree_batch(name, trees)]))]
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


# ---------------------------------------------------------------------------
# the fitted ensemble
# ---------------------------------------------------------------------------
@dataclass
class Ensemble:
    """A fitted ensemble: a table with a row for each tree, and the cuts of the features."""

    kind: str
    features: list[str]
    cuts: list[list[float]]
    trees: DataFrame
    size: int

    def groups(self, most: int = GROUP_BYTES) -> Iterator[list[dict]]:
        """Trees as arrays with real thresholds, in groups of at most about ``most`` bytes."""
        sizes = self.trees.select("tree", F.octet_length("left").alias("b")).orderBy("tree").collect()
        group, used = [], 0
        for r in sizes:
            if group and used + 8 * r["b"] > most:
                yield self._load(group)
                group, used = [], 0
            group.append(r["tree"])
            used += 8 * r["b"]
        if group:
            yield self._load(group)

    def _load(self, trees: list[int]) -> list[dict]:
        rows = self.trees.where(F.col("tree").between(trees[0], trees[-1])).orderBy("tree").collect()
        out = []
        for r in rows:
            t = {c: np.frombuffer(r[c], d) for c, d in _PARTS}
            inner = np.flatnonzero(t["left"])
            t["threshold"] = np.zeros(len(t["left"]))
            t["threshold"][inner] = [self.cuts[f][c] for f, c in zip(t["feature"][inner].tolist(), t["cut"][inner].tolist())]
            out.append(t)
        return out

    def raw(self, columns: list[Column]) -> Column:
        """Margin (boosting) or probability (forest) from the feature columns, in the order of ``features``."""
        spark = self.trees.sparkSession
        ship_package(spark)
        held = [spark.sparkContext.broadcast(group) for group in self.groups()]

        @F.pandas_udf("double")
        def sums(*xs: pd.Series) -> pd.Series:
            x = np.stack([v.to_numpy(dtype=float) for v in xs], axis=1) if len(xs[0]) else np.zeros((0, len(xs)))
            out = np.zeros(len(x))
            for group in held:
                out += predict(group.value, x)
                if len(held) > 1:
                    forget(group)
            return pd.Series(out)
        total = sums(*columns) if held else F.lit(0.0)
        return total if self.kind == "gbt" else total / F.lit(float(self.size))

    def probability(self, columns: list[Column]) -> Column:
        raw = self.raw(columns)
        return raw if self.kind == "rf" else 1.0 / (1.0 + F.exp(-raw))

    def importances(self) -> dict[str, float]:
        """Per feature, of total 1: boosting: mean gain of its splits; forest: mean of the trees' shares of impurity decrease."""
        total, splits = np.zeros(len(self.features)), np.zeros(len(self.features))
        for group in self.groups():
            for t in group:
                inner = np.flatnonzero(t["left"])
                per = np.bincount(t["feature"][inner], t["gain"][inner], len(self.features))
                if self.kind == "gbt":
                    total += per
                    splits += np.bincount(t["feature"][inner], minlength=len(self.features))
                elif per.sum() > 0:
                    total += per / per.sum()
        if self.kind == "gbt":
            total = np.divide(total, splits, out=np.zeros_like(total), where=splits > 0)
        return dict(zip(self.features, (total / total.sum() if total.sum() > 0 else total).tolist()))

    def about(self) -> dict:
        """All but the trees, as plain values."""
        return {"kind": self.kind, "features": self.features, "cuts": self.cuts, "size": self.size}

    @classmethod
    def of(cls, trees: DataFrame, about: dict) -> "Ensemble":
        return cls(about["kind"], about["features"], about["cuts"], trees, about["size"])

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        meta = json.dumps(self.about())
        self.trees.sparkSession.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        return cls.of(spark.read.parquet(f"{path}/trees"), json.loads(spark.read.parquet(f"{path}/meta").first()["meta"]))


def forget(held) -> None:
    """Drops a broadcast value from this worker's memory; it is read again from its file when it is needed."""
    if getattr(held, "_path", None):
        vars(held).pop("_value", None)


def predict(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for each row."""
    out = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if t["left"][0] else np.empty(0, np.int64)
        while len(rows):
            node = at[rows]
            at[rows] = t["left"][node] + (x[rows, t["feature"][node]] > t["threshold"][node])
            rows = rows[t["left"][at[rows]] > 0]
        out += t["value"][at]
    return out
