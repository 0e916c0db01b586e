"""Exact-size deterministic sampling and stratified splitting.

Every sampler here is "take the k rows with the smallest seeded hash", which is
a uniform sample without replacement that both Spark and plain SQL reproduce
exactly (``md5(key || ':' || seed)``, ties broken by the row key).

Scale design (the core primitive is :func:`smallest_by_hash`):

* A naive ``row_number() OVER (PARTITION BY group ORDER BY hash)`` sends a whole
  group to one task; a group (year, class) can hold a third of 100 TB.
* Instead one scan counts rows per (group, first 3 hex digits of the hash): a
  partial aggregation with at most 4096 counters per group.  The counts give
  both the group sizes and the boundary bucket, where the running count
  crosses k.
* A second scan writes the candidates.  A sample keeps the rows up to and with
  the boundary bucket (about k + n / 4096 rows); a split, which returns all
  rows, keeps the hash and ties of the boundary bucket alone.  All that follows
  reads the candidates: a boundary bucket of more than ``MAX_BOUNDARY_ROWS``
  rows is cut by the next 3 hex digits, a smaller one is ranked exactly.
* The result is one cut tuple (hash, tie keys) per group, and the sample or the
  split is a row-wise predicate ``(hash, ties) <= cut``: no join of the data
  with itself, no window over the data, no sort of the data.
* A bounded heap of k rows per task would need one scan, but it would shuffle
  up to k rows of every task: at k = 100,000 a group that is nearly the table.
* The boundary tables have a row for each group; they are written (lineage
  cut, survives executor loss), counted, and broadcast only if that count is
  within bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.common import BROADCAST_MAX_ROWS, written
from punctual.session import checkpoint_dir

MAX_BOUNDARY_ROWS = 1_000_000
HEX_STEP = 3


def hash_hex(key: str | Column, seed: int = 42) -> Column:
    """Seeded 32-hex-digit hash of a key (same value in Spark and SQL)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


#: No hash reaches this bound.
ALL_HASHES = "g"


def hash_bound(share: float) -> str:
    """The bound below which the hashes of about a ``share`` of all keys lie."""
    return format(int(share * 16 ** 12), "012x") if share < 1 else ALL_HASHES


def _attach(df: DataFrame, small: DataFrame, groups: list[str], n_small: int, how: str = "inner") -> DataFrame:
    """Attach a small per-group table to ``df``.

    With group columns it is an equi-join, broadcast when ``n_small`` (already
    counted) is within the broadcast bound.  Without groups the small table has
    at most one row and its columns become scalar subqueries -- no join.
    """
    if groups:
        side = F.broadcast(small) if n_small <= BROADCAST_MAX_ROWS else small
        return df.join(side, groups, how)
    return df.select("*", *[small.select(c).scalar().alias(c) for c in small.columns])


def _boundary(hist: DataFrame, groups: list[str], need: Column, whole: bool) -> DataFrame:
    """Per group the bucket of ``hist`` (groups, bucket, cnt) that holds the ``need``-th of its n rows: group columns,
    ``__all`` (every row is wanted; only with ``whole``), the place of that row in the bucket (``need``), ``prefix`` and
    ``size`` of the bucket.  Groups of which nothing is wanted are absent."""
    every = Window.partitionBy(*groups)
    running = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("n", F.sum("cnt").over(every)).withColumn("k", F.least(need, F.col("n"))) \
            .withColumn("cum", F.sum("cnt").over(running))
    first = h.groupBy(*groups).agg(
        F.first("k").alias("k"), (F.first("k") >= F.first("n")).alias("every"),
        F.min_by(F.struct("bucket", "cnt", "cum"), F.when(F.col("cum") >= F.col("k"), F.col("bucket"))).alias("b"))
    return written(first.filter(F.col("k") > 0).select(
        *groups, (F.lit(whole) & F.col("every")).alias("__all"),
        (F.col("k") - (F.col("b.cum") - F.col("b.cnt"))).alias("need"), F.col("b.bucket").alias("prefix"),
        F.col("b.cnt").alias("size")), "sample-bound")


def _sizes(bound: DataFrame) -> tuple[int, int, int]:
    """Groups, open groups (not every row wanted), and rows of the largest boundary bucket of these."""
    st = bound.agg(F.count(F.lit(1)).alias("g"), F.count_if(~F.col("__all")).alias("o"),
                   F.max(F.when(~F.col("__all"), F.col("size"))).alias("m")).first()
    return st["g"], st["o"], st["m"] or 0


def hash_cut(rows: DataFrame, hx: str, ties: list[str], groups: list[str], bound: DataFrame,
             n_groups: int, largest: int) -> DataFrame:
    """Per group of ``bound`` the ``__cut`` struct (hash, ties) of the row wanted; rows ``<=`` it are in the sample.

    ``rows`` has at least the rows of the boundary buckets; ``n_groups`` counts the groups, ``largest`` the rows of the
    largest bucket.
    """
    width = HEX_STEP
    slim = rows.select(*groups, hx, *ties)
    while True:
        inside = _attach(slim, bound.select(*groups, "need", "prefix"), groups, n_groups) \
            .filter(F.substring(hx, 1, width) == F.col("prefix"))
        if largest <= MAX_BOUNDARY_ROWS or width + HEX_STEP > 32:
            # exact rank inside the (small) boundary bucket of every group
            w = Window.partitionBy(*groups).orderBy(hx, *ties)
            return (inside.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == F.col("need"))
                          .select(*groups, F.struct(F.col(hx), *[F.col(t) for t in ties]).alias("__cut")))
        width += HEX_STEP
        hist = inside.groupBy(*groups, F.substring(hx, 1, width).alias("bucket")) \
                     .agg(F.count(F.lit(1)).alias("cnt"), F.first("need").alias("need"))
        bound = _boundary(hist, groups, F.col("need"), False)
        largest = _sizes(bound)[2]


def smallest_by_hash(df: DataFrame, key: str, ties: list[str], k: int | None = None,
                     groups: list[str] | None = None, fraction: float | None = None,
                     seed: int = 42, flag: str | None = None) -> DataFrame:
    """Rows with the k smallest ``md5(key:seed)`` per group (ties by ``ties``).

    Give ``k`` (rows per group; fewer when the group is smaller) or
    ``fraction`` (k = round(fraction * n) per group).  With ``flag`` every row
    is returned with a boolean column ``flag`` instead of filtering.
    """
    checkpoint_dir(df.sparkSession)
    groups = list(groups or [])
    hx = "__hx"
    d = df.withColumn(hx, hash_hex(key, seed))
    hist = written(d.groupBy(*groups, F.substring(hx, 1, HEX_STEP).alias("bucket"))
                   .agg(F.count(F.lit(1)).alias("cnt")), "sample-counts")
    wanted = F.lit(int(k)).cast("long") if k is not None else F.round(F.col("n") * F.lit(float(fraction))).cast("long")
    bound = _boundary(hist, groups, wanted, True)
    n_groups, n_open, largest = _sizes(bound)
    none = F.lit(None).cast(d.select(F.struct(F.col(hx), *[F.col(t) for t in ties])).schema.fields[0].dataType)
    cuts = bound.filter("__all").select(*groups, "__all", none.alias("__cut"))
    if n_open:
        near = bound.select(*groups, "__all", F.col("prefix").alias("__prefix"))
        held = _attach(d.select(*groups, hx, *ties) if flag else d, near, groups, n_groups)
        bucket = F.substring(hx, 1, HEX_STEP)
        keep = ~F.col("__all") & (bucket == F.col("__prefix")) if flag \
            else F.col("__all") | (bucket <= F.col("__prefix"))
        held = written(held.filter(keep).drop("__all", "__prefix"), "sample-candidates")
        d = d if flag else held
        cut = hash_cut(held, hx, ties, groups, bound.filter("NOT __all"), n_open, largest)
        cuts = cuts.unionByName(cut.select(*groups, F.lit(False).alias("__all"), "__cut"))
    j = _attach(d, cuts, groups, n_groups, "left")
    inside = F.coalesce(F.col("__all"), F.lit(False)) | \
        F.coalesce(F.struct(F.col(hx), *[F.col(t) for t in ties]) <= F.col("__cut"), F.lit(False))
    if flag:
        out = j.withColumn(flag, inside)
    else:
        out = j.filter(inside)
    return out.drop(hx, "__all", "__cut")


# ---------------------------------------------------------------------------
# M1-M7 as used by the dataset-building pipeline
# ---------------------------------------------------------------------------
def sample_per_group(df: DataFrame, group: str, k: int, key: str, ties: list[str], seed: int = 42) -> DataFrame:
    """Uniform k rows per group (per input file / year), seed fixed per group."""
    return smallest_by_hash(df, key, ties, k=k, groups=[group], seed=seed)


def sample_rows(df: DataFrame, n: int, key: str, ties: list[str], seed: int = 42,
                where: Column | None = None) -> DataFrame:
    """M2/M6: uniform n rows of the rows matching ``where`` (all rows if None)."""
    if where is not None:
        df = df.filter(where)
    return smallest_by_hash(df, key, ties, k=n, seed=seed)


def stratified_split(df: DataFrame, label: str, train_fraction: float, key: str, ties: list[str],
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """M3/M4: per label value, the round(fraction * n) smallest hashes go to 'train'."""
    f = smallest_by_hash(df, key, ties, fraction=train_fraction, groups=[label], seed=seed, flag="__train")
    return f.withColumn(split_col, F.when(F.col("__train"), "train").otherwise("test")).drop("__train")


def class_balance(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Rows per class, share, and negatives-per-positive ratio (per split)."""
    by = list(by or [])
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    pos = F.sum(F.when(F.col(label) == 1, F.col("rows"))).over(w)
    neg = F.sum(F.when(F.col(label) == 0, F.col("rows"))).over(w)
    return counts.select("*", (F.col("rows") / F.sum("rows").over(w)).alias("share"),
                         F.try_divide(neg, pos).cast("double").alias("neg_per_pos"))


def _least_without(cand: DataFrame, exclude: DataFrame, label: str, k: int, key: str, ties: list[str],
                   seed: int) -> DataFrame:
    """Rows of ``cand`` that do not occur in ``exclude``: more than the ``k`` of least hash, or all.

    One scan counts the rows of each bucket of the hash.  Only the rows of the least buckets, about k and as many as are
    excluded, meet ``exclude`` in a join; should too few be left, twice as many do.
    """
    bucket = F.substring(hash_hex(key, seed), 1, HEX_STEP)
    hist = written(cand.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt")), "balance-counts")
    running = hist.withColumn("cum", F.sum("cnt").over(   # at most 4097 rows
        Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    need = k + 1 + exclude.filter(F.col(label) == 1).count()
    while True:
        last = running.filter(F.col("cum") >= need).agg(F.min("bucket")).first()[0]
        near = cand if last is None else cand.filter((bucket <= last) | bucket.isNull())
        left = written(near.join(exclude.select(*ties), ties, "left_anti"), "balance-candidates")
        if last is None or left.count() > k:
            return left
        need *= 2


def balance_classes(train: DataFrame, pool: DataFrame, label: str, key: str, ties: list[str],
                    exclude: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Add ``max(0, negatives - positives)`` extra positive rows from ``pool``.

    The extra rows are a uniform hash sample of the positive rows in ``pool``
    (columns aligned to ``train``); with ``exclude`` (e.g. the test split) rows
    whose key occurs there are removed first (left anti join), so the balanced
    train set cannot leak test rows.  Like the reference, a drawn row may
    already be in ``train`` (oversampling).
    """
    n = train.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"),
                  F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")).first()
    extra = max(0, int(n["neg"] or 0) - int(n["pos"] or 0))
    if extra == 0:
        return train
    cand = pool.filter(F.col(label) == 1)
    if exclude is not None:
        cand = _least_without(cand, exclude, label, extra, key, ties, seed)
    cols = [c for c in train.columns if c in cand.columns]
    add = smallest_by_hash(cand.select(*cols), key, ties, k=extra, seed=seed)
    return train.unionByName(add, allowMissingColumns=True)
