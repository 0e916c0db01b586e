"""Modelling-table preparation: L1-L7 and X6.

The fitted preprocessing state (medians, means, standard deviations, class
dictionaries) is itself a small DataFrame, computed with exact aggregates in
one pass per table and applied with a join to the class dictionary (whose size
is bounded by the number of distinct category values) -- never with a
driver-side dictionary or a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions import features as fx
from punctual.operators.filters import exclude_cancelled_diverted
from punctual.schema import LEAKY_COLUMNS, MODEL_FEATURES, MODEL_TABLE_COLUMNS, TARGET
from punctual.sources.flights import ROW_KEY


def add_serving_columns(df: DataFrame) -> DataFrame:
    """Derive raw columns the model expects when the source lacks them."""
    d = F.col("FlightDate")
    extra = {}
    if "DayofMonth" not in df.columns:
        extra["DayofMonth"] = F.dayofmonth(d)
    if "Quarter" not in df.columns:
        extra["Quarter"] = F.quarter(d)
    if "DistanceGroup" not in df.columns and "Distance" in df.columns:
        extra["DistanceGroup"] = fx.distance_group("Distance")
    if "DepTimeBlk" not in df.columns and "DepHour" in df.columns:
        extra["DepTimeBlk"] = F.when(F.col("DepHour").isNotNull(), fx.dep_time_block("DepHour"))
    return df.withColumns(extra) if extra else df


def model_dataset(feat: DataFrame, key: list[str] = ROW_KEY) -> DataFrame:
    """L1 (P-5, F27, P-8): flights that operated, pre-departure columns + target.

    ``key`` columns are kept first as the row identity (the reference used the
    pandas index).
    """
    df = add_serving_columns(exclude_cancelled_diverted(feat))
    if TARGET not in df.columns:
        df = df.withColumn(TARGET, fx.is_delayed("ArrDelayMinutes"))
    keep = [c for c in key if c in df.columns]
    keep += [c for c in MODEL_TABLE_COLUMNS if c in df.columns and c not in keep]
    return df.select(*keep, TARGET).dropna(subset=["Airline", "Origin", "Dest", TARGET])


def check_no_leakage(features: list[str]) -> None:
    """L2: refuse feature lists that contain post-departure information."""
    bad = sorted(set(features) & set(LEAKY_COLUMNS))
    if bad:
        raise ValueError(f"post-departure columns in the feature list: {bad}")


def split_feature_types(df: DataFrame, features: list[str] = MODEL_FEATURES) -> tuple[list[str], list[str]]:
    """L3: categorical (string) and numerical columns, by schema type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cat = [c for c in features if isinstance(types[c], T.StringType)]
    num = [c for c in features if c not in cat]
    return cat, num


# ---------------------------------------------------------------------------
# L4/L5 impute + scale, L6/L7 label encoding
# ---------------------------------------------------------------------------
def fit_impute_scale(train: DataFrame, numeric: list[str]) -> DataFrame:
    """Exact median (numpy semantics, not ``ml.Imputer``), then the mean and the
    *population* standard deviation of the imputed column (zero -> 1).

    Two passes over ``train``: medians first (needed to impute), then moments.
    Returns ``(feature, median, mean, std)``.
    """
    med = train.agg(*[F.median(F.col(c).try_cast("double")).alias(c) for c in numeric]).first()
    imputed = train.select(*[F.coalesce(F.col(c).try_cast("double"), F.lit(med[c])).alias(c) for c in numeric])
    mom = imputed.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(numeric)],
                      *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(numeric)]).first()
    rows = [(c, None if med[c] is None else float(med[c]), mom[f"m_{i}"],
             1.0 if not mom[f"s_{i}"] else float(mom[f"s_{i}"])) for i, c in enumerate(numeric)]
    schema = "feature string, median double, mean double, std double"
    return train.sparkSession.createDataFrame(rows, schema)


def apply_impute_scale(df: DataFrame, params: DataFrame, numeric: list[str]) -> DataFrame:
    """(coalesce(x, median) - mean) / std; bad numbers become null -> 0."""
    p = {r["feature"]: r for r in params.collect()}  # one row per feature (<= 16)
    out = {}
    for c in numeric:
        r = p[c]
        x = F.coalesce(F.col(c).try_cast("double"), F.lit(r["median"]))
        out[c] = F.coalesce((x - F.lit(r["mean"])) / F.lit(r["std"]), F.lit(0.0))
    return df.withColumns(out)


def fit_label_encoders(train: DataFrame, categorical: list[str]) -> DataFrame:
    """Per column, sorted distinct values (nulls -> 'Unknown') coded 0..k-1.

    One pass: all columns are stacked into (feature, value) and de-duplicated
    together; the code is a rank inside each feature over the distinct values
    only (bounded by the column's cardinality).
    """
    pairs = ", ".join(f"'{c}', coalesce(CAST(`{c}` AS STRING), 'Unknown')" for c in categorical)
    long = train.selectExpr(f"stack({len(categorical)}, {pairs}) AS (feature, value)").distinct()
    w = Window.partitionBy("feature").orderBy("value")
    return long.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def apply_label_encoders(df: DataFrame, classes: DataFrame, categorical: list[str]) -> DataFrame:
    """Encode; a value unseen in training gets code 0 (the alphabetically
    first class -- the reference's behaviour).  One broadcast join per column
    against that column's class list (size = its cardinality, counted first)."""
    from punctual.operators.common import checked_broadcast
    out = df
    for c in categorical:
        dim = classes.filter(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"),
                                                           F.col("code").alias(f"__c_{c}"))
        out = (out.withColumn(f"__v_{c}", F.coalesce(F.col(c).cast("string"), F.lit("Unknown")))
                  .join(checked_broadcast(dim), f"__v_{c}", "left")
                  .withColumn(c, F.coalesce(F.col(f"__c_{c}"), F.lit(0)))
                  .drop(f"__v_{c}", f"__c_{c}"))
    return out


def decode_feature(encoded: DataFrame, params: DataFrame, classes: DataFrame, feature: str,
                   value_col: str = "value") -> DataFrame:
    """Model-space value back to the raw value (x * std + mean, or class name) in ``<feature>_raw``."""
    numeric = [feature] if params.filter(F.col("feature") == feature).limit(1).count() else []
    one = encoded.withColumn(feature, F.col(value_col))
    out = decode_rows(one, params, classes, numeric, [] if numeric else [feature])
    return out.withColumnRenamed(feature, f"{feature}_raw")


def decode_rows(encoded: DataFrame, params: DataFrame, classes: DataFrame, numeric: list[str],
                categorical: list[str]) -> DataFrame:
    """X6 for whole rows: scaled numbers back to x * std + mean, codes back to class names.

    A code beyond the classes reads as the first class.  A null stays null."""
    p = {r["feature"]: r for r in params.collect()}          # one row per feature (<= 16)
    out = encoded.withColumns({c: F.col(c) * F.lit(p[c]["std"]) + F.lit(p[c]["mean"]) for c in numeric})
    from punctual.operators.common import checked_broadcast
    for c in categorical:
        own = classes.filter(F.col("feature") == c)
        names = own.select(F.col("code").alias(f"__c_{c}"), F.col("value").alias(f"__v_{c}"))
        first = own.filter(F.col("code") == 0).select("value").scalar()
        out = (out.withColumn(f"__c_{c}", F.col(c).cast("int")).join(checked_broadcast(names), f"__c_{c}", "left")
               .withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"__v_{c}"), first)))
               .drop(f"__c_{c}", f"__v_{c}"))
    return out
