"""Histograms, box-plot statistics, binned summaries, correlations.

* Histogram ranges and box-plot quartiles are a few numbers from one small
  aggregation, inlined into the per-row expressions as literals: no join.
* Bin counts are a partial + final aggregation over at most ``bins`` keys;
  empty bins come back from a generated (series, bin) grid left-joined with
  that bounded aggregate.
* Correlation pairs are ``corr`` aggregates (co-moment state merged
  map-side); a matrix is one pass in which every task merges its Arrow batches
  into one k x k summary.
* Average ranks are computed on (feature, distinct value) counts by ranged
  prefix sums.  Spearman looks every row's ranks up in that dictionary on the
  way into the same pass: no row is ever sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.bins import cut
from punctual.operators.common import prefix_sums
from punctual.session import fresh_path


# ---------------------------------------------------------------------------
# D1 / D2 histograms
# ---------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 100, series: dict[str, Column] | None = None) -> DataFrame:
    """Equal-width histogram of the non-null values of ``col`` over [min, max].

    The last bin is closed on the right (numpy semantics).  ``series`` maps a
    fixed set of labels to row predicates (first match wins); one histogram per
    label is built, each over its own range.  The ranges of all labels come
    from one small aggregation (two numbers per label, collected), so the
    binning itself is a single pass with literal bounds and no join.
    """
    spark = df.sparkSession
    series = series or {"all": F.lit(True)}
    s = None
    for lab, cond in series.items():
        s = F.when(cond, lab) if s is None else s.when(cond, lab)
    x = df.select(s.alias("series"), F.col(col).cast("double").alias("x")) \
          .filter(F.col("x").isNotNull() & F.col("series").isNotNull())
    aggs = []
    for i, lab in enumerate(series):
        xi = F.when(F.col("series") == lab, F.col("x"))
        aggs += [F.min(xi).alias(f"lo{i}"), F.max(xi).alias(f"hi{i}")]
    r = x.agg(*aggs).first()                                # 2 numbers per label
    rng = {lab: (r[f"lo{i}"], r[f"hi{i}"]) for i, lab in enumerate(series)}
    b = None
    for lab, (lo, hi) in rng.items():
        if lo is None:
            continue
        w = (hi - lo) / bins
        e = F.lit(0) if w == 0 else F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(w)), F.lit(bins - 1))
        b = F.when(F.col("series") == lab, e) if b is None else b.when(F.col("series") == lab, e)
    grid = spark.createDataFrame(
        [(lab, i, lo + i * ((hi - lo) / bins), lo + (i + 1) * ((hi - lo) / bins))
         for lab, (lo, hi) in rng.items() if lo is not None for i in range(bins)],
        "series string, bin int, bin_lo double, bin_hi double")
    if b is None:
        return grid.withColumn("count", F.lit(0).cast("long"))
    counts = x.select("series", b.cast("int").alias("bin")).groupBy("series", "bin") \
              .agg(F.count(F.lit(1)).alias("count"))
    # the grid has len(series) * bins rows; counts has at most as many
    return (grid.join(F.broadcast(counts), ["series", "bin"], "left")
                .withColumn("count", F.coalesce(F.col("count"), F.lit(0).cast("long")))
                .orderBy("series", "bin"))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """D3: quartiles (linear), 1.5 IQR whiskers and outlier count of non-null values.

    Two passes: the three quartiles (one aggregation, three numbers collected),
    then counts / whiskers with the fences as literals.
    """
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    q = x.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()["q"]
    q1, med, q3 = (None, None, None) if q is None else q
    xs = F.col("x")
    if q1 is None:
        lo_f = hi_f = F.lit(None).cast("double")
        iqr = None
    else:
        iqr = q3 - q1
        lo_f, hi_f = F.lit(q1 - 1.5 * iqr), F.lit(q3 + 1.5 * iqr)
    lit = lambda v: F.lit(v).cast("double")
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.min(xs).alias("min"), lit(q1).alias("q1"), lit(med).alias("median"),
        lit(q3).alias("q3"), lit(iqr).alias("iqr"),
        F.min(F.when(xs >= lo_f, xs)).alias("lower_whisker"),
        F.max(F.when(xs <= hi_f, xs)).alias("upper_whisker"),
        F.count_if((xs < lo_f) | (xs > hi_f)).alias("outliers"), F.max(xs).alias("max"))


# ---------------------------------------------------------------------------
# A21 / A22 / F20 binned summaries
# ---------------------------------------------------------------------------
def binned_delay_eda(df: DataFrame, col: str, edges: list[float], labels: list[str],
                     min_rate_flights: int = 100) -> DataFrame:
    """Rows with ``col``, arrival and departure delay all present, binned by
    ``col``: mean, std, count of arrival delay; delay rate only for bins with at
    least ``min_rate_flights`` rows.  All bins listed (empty ones with count 0)."""
    from punctual.operators.aggregates import dense_bins
    d = df.filter(F.col(col).isNotNull() & F.col("ArrDelayMinutes").isNotNull()
                  & F.col("DepDelayMinutes").isNotNull())
    d = d.withColumn("bin", cut(col, edges, labels)).filter(F.col("bin").isNotNull())
    agg = d.groupBy("bin").agg(F.avg("ArrDelayMinutes").alias("avg_arr_delay"),
                               F.stddev_samp("ArrDelayMinutes").alias("std_arr_delay"),
                               F.count(F.lit(1)).alias("flights"),
                               F.avg((F.col("ArrDelayMinutes") > 15).cast("double")).alias("rate"))
    agg = agg.withColumn("delay_rate", F.when(F.col("flights") >= min_rate_flights, F.col("rate"))).drop("rate")
    return dense_bins(df.sparkSession, agg, "bin", labels, {"flights": 0})


def binned_delay_insight(df: DataFrame, col: str, edges: list[float], labels: list[str]) -> DataFrame:
    """All rows binned by ``col`` (null delays kept): average delay, delay
    rate in percent, flights; empty bins listed with 0 flights."""
    from punctual.operators.aggregates import dense_bins
    d = df.withColumn("bin", cut(col, edges, labels)).filter(F.col("bin").isNotNull())
    agg = d.groupBy("bin").agg(F.avg("ArrDelayMinutes").alias("avg_delay"),
                               (F.avg(F.col("IsArrDelayed").cast("double")) * 100).alias("delay_rate_pct"),
                               F.count(F.lit(1)).alias("flights"))
    return dense_bins(df.sparkSession, agg, "bin", labels, {"flights": 0})


# ---------------------------------------------------------------------------
# C1-C7 correlation
# ---------------------------------------------------------------------------
def corr_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson r of each pair over rows where both values are present."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}"),
                 F.count_if(both).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n_pairs"),
                     F.col(f"r{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Distinct values, over all columns, whose ranks (16 bytes each) tasks may hold.
DICTIONARY_ROWS = 1_000_000


def _joined_ranks(rows: DataFrame, cols: list[str], dictionary: DataFrame, n: int) -> DataFrame:
    """``rows`` with the values of ``cols`` replaced by their ranks, joined by value.

    Values that hold more than a task's share of the rows are at most as many as there are tasks; they are looked up by
    broadcast, and their rows go to the join under a salted key that matches nothing.  So no task receives all rows of
    a value."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, heavy = rows, F.col("cnt") > n / tasks
    for c in cols:
        own = dictionary.where(F.col("feature") == c)
        few = own.where(heavy).select(F.col("value").alias("__hv"), F.col("rank").alias("__hk"))
        many = own.where(~heavy).select(F.col("value").alias("__lv"), F.col("rank").alias("__lk"),
                                        F.lit(0).cast("long").alias("__ls"))
        salt = F.when(F.col("__hk").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns).bitwiseOR(F.lit(1)))
        out = out.join(F.broadcast(few), F.col(c) == F.col("__hv"), "left").withColumn("__salt", salt)
        out = out.join(many, (F.col(c) == F.col("__lv")) & (F.col("__salt") == F.col("__ls")), "left") \
            .withColumn(c, F.coalesce("__hk", "__lk")).select(*rows.columns)
    return out


def _correlations(rows: DataFrame, cols: list[str], held: dict[str, tuple]) -> np.ndarray:
    """Pearson matrix of complete rows in one pass: every task merges the counts, means and centred products of its
    batches into one summary of k x k numbers, and the summaries of the tasks are merged alike.

    ``held``: (values, ranks) of the columns that are replaced by ranks on the way.  NaN where a column is constant."""
    k, tables = len(cols), rows.sparkSession.sparkContext.broadcast(held)

    def merged(a, b):
        n = a[0] + b[0]
        if not a[0] or not b[0]:
            return a if a[0] else b
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)
    nothing = (0, np.zeros(k), np.zeros((k, k)))

    def run(batches):
        total = nothing
        for batch in batches:
            if batch.num_rows:
                x = np.empty((batch.num_rows, k))
                for i, c in enumerate(cols):
                    v = batch.column(i).to_numpy(zero_copy_only=False)
                    if c in tables.value:
                        values, ranks = tables.value[c]
                        v = ranks[np.searchsorted(values, v)]
                    x[:, i] = v
                mean = x.mean(axis=0)
                x -= mean
                total = merged(total, (len(x), mean, x.T @ x))
        yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()),
                                          pa.array([total[2].tobytes()], pa.binary())], names=["n", "mean", "products"])
    total = nothing
    for r in rows.select(*cols).mapInArrow(run, "n long, mean binary, products binary").collect():    # a row for each task
        total = merged(total, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k)))
    spread = np.sqrt(np.diag(total[2]))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = total[2] / np.outer(spread, spread)
    np.fill_diagonal(out, 1.0)
    return out


def _cells(df: DataFrame, cols: list[str], r: np.ndarray, against: str | None) -> DataFrame:
    rows = [(a, b, float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, a in enumerate(cols) for j, b in enumerate(cols)
            if against is None or b == against]
    return df.sparkSession.createDataFrame(rows, "feature_x string, feature_y string, r double")


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna(how="any")


def corr_matrix(df: DataFrame, cols: list[str], method: str = "pearson", against: str | None = None) -> DataFrame:
    """Correlation matrix (long: feature_x, feature_y, r) over rows with no null in ``cols`` (listwise deletion);
    the whole matrix, or only its column ``against``.  A constant column has null correlations."""
    if method == "spearman":
        return spearman_matrix(df, cols, against)
    return _cells(df, cols, _correlations(_complete(df, cols), cols, {}), against)


def spearman_matrix(df: DataFrame, cols: list[str], against: str | None = None) -> DataFrame:
    """Spearman rank correlations (long: feature_x, feature_y, r) over rows with no null in ``cols``; the whole matrix,
    or only its column ``against``.

    Ranks come from counts of distinct values.  The smallest dictionaries, ``DICTIONARY_ROWS`` values together, are held
    by the tasks; the ranks of larger ones are computed by ranged prefix sums and joined.  The rows are read twice.
    """
    spark = df.sparkSession
    complete, path = _complete(df, cols), fresh_path(df.sparkSession, "value-counts")
    value_counts(complete, cols).write.parquet(path)
    counts = spark.read.schema("feature string, value double, cnt long").parquet(path)
    sizes = {r["feature"]: r for r in counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("values"), F.sum("cnt").alias("n")).collect()}       # a row for each column
    n, left, small = max((r["n"] for r in sizes.values()), default=0), DICTIONARY_ROWS, []
    for c in sorted(sizes, key=lambda c: (sizes[c]["values"], c)):
        if sizes[c]["values"] <= left:
            small.append(c)
            left -= sizes[c]["values"]
    held: dict[str, tuple] = {}
    if small:
        fetched = counts.where(F.col("feature").isin(small)).toPandas()              # counted just before
        for c, part in fetched.sort_values(["feature", "value"]).groupby("feature"):
            cnt = part["cnt"].to_numpy()
            held[c] = (part["value"].to_numpy(), np.cumsum(cnt) - (cnt - 1) / 2.0)
    large = [c for c in cols if c in sizes and c not in held]
    rows = complete
    if large:
        ranks = fresh_path(spark, "ranks")
        _ranks_of(counts.where(F.col("feature").isin(large))).write.parquet(ranks)
        dictionary = spark.read.schema("feature string, value double, cnt long, rank double").parquet(ranks)
        rows = _joined_ranks(complete, large, dictionary, n)
    return _cells(df, cols, _correlations(rows, cols, held), against)


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, cnt) for every column, in one stacked aggregation."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, value)")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _ranks_of(counts: DataFrame) -> DataFrame:
    sums = prefix_sums(counts, ["feature", "value"], ["cnt"], ("feature",))
    return sums.select("feature", "value", "cnt", (F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0).alias("rank"))


def average_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, cnt, rank): average rank of every distinct value (ties get the mean of their ranks)."""
    return _ranks_of(value_counts(df, cols).filter(F.col("value").isNotNull()))


def corr_with_target(matrix: DataFrame, target: str, k: int = 10) -> DataFrame:
    """C4: correlations with ``target`` by absolute value (self removed), top k."""
    m = matrix.filter((F.col("feature_y") == target) & (F.col("feature_x") != target))
    m = m.select(F.col("feature_x").alias("feature"), F.col("r").alias("r"),
                 F.abs("r").alias("abs_r"),
                 F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")
                 .alias("direction"))
    return m.orderBy(F.col("abs_r").desc_nulls_last(), "feature").limit(k) \
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("abs_r").desc_nulls_last(), "feature")))


def corr_compare(pearson: DataFrame, spearman: DataFrame, target: str) -> DataFrame:
    """|Pearson| and |Spearman| with the target side by side (matrices are
    |cols|^2 rows, so this join is between two tiny tables)."""
    p = pearson.filter(F.col("feature_y") == target).select(F.col("feature_x").alias("feature"),
                                                             F.abs("r").alias("pearson_abs"))
    s = spearman.filter(F.col("feature_y") == target).select(F.col("feature_x").alias("feature"),
                                                              F.abs("r").alias("spearman_abs"))
    return p.join(s, "feature").orderBy(F.col("pearson_abs").desc(), "feature")


def indicator_corr(df: DataFrame, cat: str, y: str, min_rows: int = 100, k: int = 15) -> DataFrame:
    """Pearson r between the one-hot indicator of each category value and
    ``y`` -- without materialising any one-hot column.

    Rows with null ``y`` are dropped for every category (pairwise deletion);
    for n rows, category size n_a, sums S, S_a and Q = sum(y^2):
    r_a = (n*S_a - n_a*S) / sqrt(n_a*(n - n_a) * (n*Q - S^2)).
    One aggregation per category value (bounded), then a window over that
    small per-category table supplies the global n, S, Q.
    """
    yv = F.col(y).cast("double")
    per = df.groupBy(cat).agg(F.count(F.lit(1)).alias("n_all"), F.count(yv).alias("n_a"),
                              F.sum(yv).alias("s_a"), F.sum(yv * yv).alias("q_a"))
    w = Window.partitionBy(F.lit(0))  # over the per-category rows only
    n, s, q = F.sum("n_a").over(w), F.sum("s_a").over(w), F.sum("q_a").over(w)
    per = per.select("*", n.alias("n"), s.alias("s"), q.alias("q"))
    num = F.col("n") * F.col("s_a") - F.col("n_a") * F.col("s")
    den = F.sqrt(F.col("n_a") * (F.col("n") - F.col("n_a")) * (F.col("n") * F.col("q") - F.col("s") * F.col("s")))
    out = (per.filter(F.col(cat).isNotNull() & (F.col("n_all") > min_rows))
              .select(cat, F.col("n_all").alias("flights"), F.try_divide(num, den).alias("corr")))
    return out.orderBy(F.col("corr").desc_nulls_last(), cat).limit(k) \
              .withColumn("rank", F.row_number().over(Window.orderBy(F.col("corr").desc_nulls_last(), cat)))


def linear_trend(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least-squares line y = slope * x + intercept for each x (pairwise complete)."""
    aggs = []
    for i, x in enumerate(xs):
        aggs += [F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias(f"s{i}"),
                 F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias(f"i{i}"),
                 F.regr_count(F.col(y).cast("double"), F.col(x).cast("double")).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"),
                     F.col(f"s{i}").alias("slope"), F.col(f"i{i}").alias("intercept")) for i, x in enumerate(xs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
