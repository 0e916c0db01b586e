"""The dataset-building pipeline (reference entry point E-2) as lazy Spark plans.

flights --(M1: k rows per year)--> sample --(features, L1)--> model table
        --(M3: stratified 60/40)--> train / test
        --(M5: + extra delayed rows from all flights, test rows excluded)--> balanced train

Each stage has an independent seed tag, so the hash orders of the stages are
independent of each other.  The split is checkpointed: it is reused by the
class counts, the balancing step and the model fit.

Both draws take the rows of least hash, and the hash is one of line-item columns.
One pass over the line items therefore drops all that lie beyond a hash bound
before the joins (``near_flights``); the draws are exact among the rest, and a
bound that proves too low is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.features import prepare_features
from punctual.operators import prep, routes, sampling
from punctual.operators.common import written
from punctual.schema import TARGET
from punctual.session import fresh_path
from punctual.sources.flights import ROW_KEY, fingerprint, flights, flights_view, line_items_by_year

SAMPLE_PER_YEAR = 100_000
TRAIN_FRACTION = 0.6
# Flights, as a multiple of the sample, whose extra-row hash is looked at first.
POOL_FACTOR = 6
SEED = 42
SPLIT_SEED = f"{SEED}:split"
EXTRA_SEED = f"{SEED}:extra"
FIT_SEED = f"{SEED}:fit"

_CACHE: dict[tuple, DataFrame | str | tuple] = {}


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route-distance store of this input, filled once for each session and input."""
    key = ("routes", spark.sparkContext.applicationId, fingerprint(spark, sf_dir))
    if key not in _CACHE:
        path = fresh_path(spark, "route-counts")
        routes.add_batch(flights(spark, sf_dir), path, "all")
        _CACHE[key] = path
    return routes.read_counts(spark, _CACHE[key])


def near_flights(spark: SparkSession, sf_dir: str, k: int = SAMPLE_PER_YEAR) -> tuple[DataFrame, bool]:
    """Flights with the flags ``__sample`` (all that can be among the ``k`` least hashes of their year) and ``__pool``
    (those with the least hashes as extra rows), written once; and whether ``__pool`` marks all flights.

    The line items of each year tell how low a hash must be.  Should a year hold fewer flights below its bound than the
    sample takes, the bounds are raised, at last to all flights.
    """
    key = ("near", spark.sparkContext.applicationId, fingerprint(spark, sf_dir), k)
    if key not in _CACHE:
        sizes = line_items_by_year(spark, sf_dir)
        total, taken = sum(sizes.values()), sum(min(n, k) for n in sizes.values())
        whole = POOL_FACTOR * taken >= total
        pool = F.lit(True) if whole else \
            sampling.hash_hex("FlightKey", EXTRA_SEED) < sampling.hash_bound(POOL_FACTOR * taken / total)
        most = k + k // 10 + 1000
        while True:
            bounds = {y: sampling.hash_bound(most / n) for y, n in sizes.items() if most < n}
            sample = F.col("Year").isNotNull()                  # flights without a date are in no sample
            if bounds:
                bound = F.try_element_at(F.create_map(*[F.lit(v) for b in bounds.items() for v in b]), F.col("Year"))
                sample &= sampling.hash_hex("FlightKey", SEED) < F.coalesce(bound, F.lit(sampling.ALL_HASHES))
            marked = flights_view(spark, sf_dir, {"__sample": sample, "__pool": pool})
            near = written(marked.withColumn("Year", F.year("FlightDate")), "near-flights")
            found = {r["Year"]: r["count"] for r in near.filter("__sample").groupBy("Year").count().collect()}
            if all(found.get(y, 0) >= k for y in bounds):
                break
            most *= 4
        _CACHE[key] = near, whole
    return _CACHE[key]


def sampled_flights(spark: SparkSession, sf_dir: str, k: int = SAMPLE_PER_YEAR) -> DataFrame:
    """M1: k flights per year, uniform, seeded."""
    near, _ = near_flights(spark, sf_dir, k)
    return sampling.sample_per_group(near.filter("__sample").drop("__sample", "__pool"), "Year", k, "FlightKey", ROW_KEY,
                                     seed=SEED)


def model_table(spark: SparkSession, sf_dir: str, sampled: bool = True) -> DataFrame:
    """L1 over the sampled flights (or all flights with ``sampled=False``)."""
    src = sampled_flights(spark, sf_dir) if sampled else flights(spark, sf_dir)
    return prep.model_dataset(prepare_features(src))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: model table with a ``split`` column ('train' / 'test'), checkpointed."""
    key = ("split", spark.sparkContext.applicationId, fingerprint(spark, sf_dir))
    if key not in _CACHE:
        s = sampling.stratified_split(model_table(spark, sf_dir), TARGET, TRAIN_FRACTION,
                                      "FlightKey", ROW_KEY, seed=SPLIT_SEED)
        _CACHE[key] = s.checkpoint()
    return _CACHE[key]


def balanced_train(spark: SparkSession, sf_dir: str, exclude_test: bool = True) -> DataFrame:
    """M5: train split + extra delayed rows drawn from all flights; ``source``
    tells 'base' from 'extra' rows."""
    key = ("balanced", spark.sparkContext.applicationId, fingerprint(spark, sf_dir), exclude_test)
    if key not in _CACHE:
        s = split(spark, sf_dir)
        train = s.filter(F.col("split") == "train").drop("split").withColumn("source", F.lit("base"))
        test = s.filter(F.col("split") == "test") if exclude_test else None
        near, whole = near_flights(spark, sf_dir)

        def balanced(pool: DataFrame) -> DataFrame:
            pool = pool.withColumn("source", F.lit("extra"))
            return sampling.balance_classes(train, pool, TARGET, "FlightKey", ROW_KEY, exclude=test,
                                            seed=EXTRA_SEED).checkpoint()
        out = balanced(prep.model_dataset(prepare_features(near.filter("__pool").drop("__sample", "__pool"))))
        if not whole and out.agg(F.count_if(F.col(TARGET) == 1) < F.count_if(F.col(TARGET) == 0)).first()[0]:
            # too few delayed flights are near: all are the pool
            out = balanced(model_table(spark, sf_dir, sampled=False))
        _CACHE[key] = out
    return _CACHE[key]


def fit_rows(spark: SparkSession, sf_dir: str, max_fit_rows: int | None = None) -> DataFrame:
    """The rows that models are fitted on: the whole balanced train set, or the ``max_fit_rows`` with the least hashes."""
    if max_fit_rows is None:
        return balanced_train(spark, sf_dir)
    key = ("fit", spark.sparkContext.applicationId, fingerprint(spark, sf_dir), max_fit_rows)
    if key not in _CACHE:
        out = sampling.sample_rows(balanced_train(spark, sf_dir), max_fit_rows, "FlightKey", ROW_KEY, seed=FIT_SEED)
        _CACHE[key] = out.checkpoint()
    return _CACHE[key]


def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).filter(F.col("split") == "test").drop("split")


def write_sample(spark: SparkSession, sf_dir: str, out_dir: str, k: int = SAMPLE_PER_YEAR) -> str:
    """E-1 build step: the per-year sample written as one CSV dataset."""
    from punctual.sources.files import SAMPLED_NAME, write_table
    path = f"{out_dir.rstrip('/')}/{SAMPLED_NAME}.csv"
    return write_table(sampled_flights(spark, sf_dir, k).drop("Year"), path, fmt="csv", partition_by=())


def write_datasets(spark: SparkSession, sf_dir: str, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """E-2 build step: balanced train set and real-distribution test set."""
    from punctual.sources.files import write_table
    out = {"train": f"{out_dir.rstrip('/')}/train", "test": f"{out_dir.rstrip('/')}/test"}
    write_table(balanced_train(spark, sf_dir), out["train"], fmt=fmt, partition_by=())
    write_table(test_split(spark, sf_dir), out["test"], fmt=fmt, partition_by=())
    return out
