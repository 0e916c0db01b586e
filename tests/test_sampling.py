"""Sampling properties against a brute-force pandas ordering."""

import hashlib

import pytest
from pyspark.sql import functions as F

from punctual.operators import sampling as S


def _md5(k, seed):
    return hashlib.md5(f"{k}:{seed}".encode()).hexdigest()


@pytest.fixture
def data(spark):
    # group g=0 holds the big majority of rows (a hot group)
    return spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("t"),
                                    F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("g"))


def _brute(pdf, k, seed=42):
    pdf = pdf.assign(h=[_md5(x, seed) for x in pdf.k])
    return set(pdf.sort_values(["h", "t"]).groupby("g").head(k).k)


@pytest.mark.parametrize("levels", [False, True])
def test_per_group_sample_matches_brute_force(spark, data, monkeypatch, levels):
    if levels:  # force the multi-level hash-prefix refinement on small data
        monkeypatch.setattr(S, "MAX_BOUNDARY_ROWS", 3)
    got = S.smallest_by_hash(data, "k", ["t"], k=300, groups=["g"])
    rows = got.collect()
    counts = {}
    for r in rows:
        counts[r.g] = counts.get(r.g, 0) + 1
    sizes = {r.g: r["count"] for r in data.groupBy("g").count().collect()}
    assert counts == {g: min(300, n) for g, n in sizes.items()}
    assert {r.k for r in rows} == _brute(data.toPandas(), 300)


def test_stratified_split_is_disjoint_complete_and_proportional(spark, data):
    s = S.stratified_split(data, "g", 0.6, "k", ["t"]).toPandas()
    assert len(s) == 5000 and s.k.is_unique
    for g, part in s.groupby("g"):
        assert (part.split == "train").sum() == round(0.6 * len(part))


def test_global_sample_and_where(spark, data):
    got = S.sample_rows(data, 50, "k", ["t"], where=F.col("t") % 2 == 0).collect()
    pdf = data.toPandas()
    pdf = pdf[pdf.t % 2 == 0].assign(g=0)
    assert {r.k for r in got} == _brute(pdf, 50)


def test_class_balance_adds_positives(spark):
    train = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("t"),
                                    (F.col("id") < 20).cast("int").alias("y"))
    pool = spark.range(1000, 1200).select(F.col("id").cast("string").alias("k"), F.col("id").alias("t"),
                                          F.lit(1).alias("y"))
    out = S.balance_classes(train, pool, "y", "k", ["t"])
    c = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c == {0: 80, 1: 80}


@pytest.mark.parametrize("groups,flag,scans", [(["g"], None, 2), ([], None, 2), (["g"], "in", 3)])
def test_scans_of_the_input(spark, data, groups, flag, scans):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    S.smallest_by_hash(data.mapInArrow(count, data.schema), "k", ["t"], k=40, groups=groups, flag=flag).collect()
    assert read.value == scans * 5000


@pytest.mark.parametrize("k", [0, 1, 5000, 9000])
def test_bounds_of_k(spark, data, k):
    assert S.sample_rows(data, k, "k", ["t"]).count() == min(k, 5000)
    assert S.sample_rows(data.limit(0), k, "k", ["t"]).count() == 0
    assert S.smallest_by_hash(data.limit(0), "k", ["t"], k=k, groups=["g"]).count() == 0


def test_equal_keys_are_cut_by_their_ties(spark):
    rows = spark.range(3000).select(F.lit("same").alias("k"), F.col("id").alias("t"))
    assert {r.t for r in S.sample_rows(rows, 70, "k", ["t"]).collect()} == set(range(70))


def test_balancing_pool_is_narrowed_before_the_join_with_the_test_rows(spark):
    from pyspark.sql import functions as F
    from punctual.operators import sampling
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("t"), F.lit(1).alias("y"))
    exclude = rows.filter("t % 3 = 0")
    near = sampling._least_without(rows, exclude, "y", 50, "k", ["t"], 7)
    assert 50 < near.count() < 10_000 and near.filter("t % 3 = 0").count() == 0
    want = sampling.smallest_by_hash(rows.join(exclude.select("t"), "t", "left_anti"), "k", ["t"], k=50, seed=7)
    got = sampling.smallest_by_hash(near, "k", ["t"], k=50, seed=7)
    assert {r["k"] for r in got.collect()} == {r["k"] for r in want.collect()}
    # the excluded rows are the least ones, and none may be left
    least = sampling.smallest_by_hash(rows, "k", ["t"], k=15_000, seed=7)
    assert sampling._least_without(rows, least.withColumn("y", F.lit(0)), "y", 50, "k", ["t"], 7).count() > 50
    assert sampling._least_without(rows, rows, "y", 50, "k", ["t"], 7).count() == 0
