"""Spearman by rank dictionary: against a plain computation, on both ways of looking ranks up."""

import numpy as np
import pytest

from punctual.operators import distribution as D


def plain(x):
    ranks = np.stack([[(v > c).sum() + ((v == c).sum() + 1) / 2 for v in c] for c in x.T], axis=1)
    return np.corrcoef(ranks.T)


@pytest.mark.parametrize("bound", [1_000_000, 10, 0])
def test_spearman_equals_plain_ranks(spark, monkeypatch, bound):
    rng = np.random.default_rng(3)
    n = 1500
    zero = np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n))            # one value holds most rows
    x = np.stack([zero, rng.integers(0, 7, n), zero * 2 + rng.normal(size=n), np.round(rng.normal(size=n), 1)], axis=1)
    rows = [tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0, 3.0), (5.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    monkeypatch.setattr(D, "DICTIONARY_ROWS", bound)
    want, cols = plain(x), ["a", "b", "c", "d"]
    got = {(r.feature_x, r.feature_y): r.r for r in D.spearman_matrix(df, cols).collect()}
    assert len(got) == 16
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            assert abs(got[a, b] - want[i, j]) < 1e-9
    column = {r.feature_x: r.r for r in D.spearman_matrix(df, cols, "c").collect()}
    assert column == {a: got[a, "c"] for a in cols}
    pearson = {r.feature_x: r.r for r in D.corr_matrix(df, cols, against="c").collect()}
    assert all(abs(pearson[a] - np.corrcoef(x.T)[i, 2]) < 1e-9 for i, a in enumerate(cols))


def test_spearman_without_rows_or_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = {(r.feature_x, r.feature_y): r.r for r in D.spearman_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["a", "a"] == 1.0
    assert D.spearman_matrix(df.limit(0), ["a", "b"]).count() == 4
