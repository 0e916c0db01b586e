"""Query catalog: every registered query as (Spark builder, oracle SQL).

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame computed over the
whole input tables in ``sf_dir``; ``ORACLE[name]`` is the equivalent DuckDB SQL
over the same tables (absent for model-dependent queries, which get a
rows-only check plus pytest properties).  Every double column is rounded to
6 places at the very end, identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions.features import prepare_features
from punctual.sources.flights import flights

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def finalize(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (display rounding, last projection only)."""
    cols = [F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: finalize(_fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        QUERIES[name].__name__ = name
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table over the whole flights view of ``sf_dir``."""
    return prepare_features(flights(spark, sf_dir))


# Query modules register themselves on import.
from punctual.plans import (q_aggregates, q_distribution, q_evaluation,  # noqa: E402,F401
                            q_io, q_modeling, q_reshape, q_sampling)
