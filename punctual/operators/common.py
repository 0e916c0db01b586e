"""Small helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.session import fresh_path

# Largest side (rows) we broadcast after counting it.  Callers only pass
# per-group / per-key summary tables here; the count makes the bound explicit.
BROADCAST_MAX_ROWS = 2_000_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows; otherwise
    return it unchanged so the planner uses a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back.  (``checkpoint()`` computes its input twice.)"""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: list, values: list[str], group: tuple[str, ...] = (),
                parts: int | None = None) -> DataFrame:
    """``df`` with ``cum_<value>``: running sums (the row itself included) in ``order`` within ``group``.

    One path at every size: rows are cut into ranges of the order, each range is
    summed where it lies, and what lies before a range (a row for each range and
    group) is added.  ``order`` must begin with the group columns and make rows distinct.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    whole = cut.groupBy("__part", *group).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*(group or (F.lit(0),))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("__part", *group, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{v}")
                                              for v in values])
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (cut.join(before, ["__part", *group])
            .withColumns({f"cum_{v}": F.sum(v).over(inside) + F.col(f"__{v}") for v in values})
            .drop("__part", *[f"__{v}" for v in values]))
