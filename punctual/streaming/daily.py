"""Incremental daily delay summary over arriving flight files (Structured Streaming).

The reference reads finished files only; this is the same daily summary (A9,
algebraic measures) maintained incrementally as new parquet files land in a
folder.  State is one row per calendar day (bounded by the number of days).
Each micro-batch writes the complete result into a folder of its own below the
sink; ``read_daily`` takes the newest whole one, so a reader never sees half a
result.  The caller names the stream's checkpoint: a restarted job that passes
the same one resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions.features import add_delay_flags
from punctual.operators import aggregates as A


def daily_measures(feat: DataFrame) -> DataFrame:
    """Streaming-safe part of the daily summary (means and rates; medians need
    the whole day's values and stay in the batch version)."""
    return A.group(feat, ["FlightDate"], {
        "avg_arr_delay": A.mean("ArrDelayMinutes"), "avg_dep_delay": A.mean("DepDelayMinutes"),
        "arr_delay_rate": A.rate("IsArrDelayed"), "dep_delay_rate": A.rate("IsDepDelayed"),
        "cancel_rate": A.rate("Cancelled"), "divert_rate": A.rate("Diverted"), "total_flights": A.size()})


def start_daily_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_path: str,
                       checkpoint: str, available_now: bool = True):
    """Run the daily summary over ``source_dir`` (parquet files) into ``sink_path``."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    agg = daily_measures(add_delay_flags(src))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/version={epoch:012d}")

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_daily(spark: SparkSession, sink_path: str) -> DataFrame:
    """The newest whole result below ``sink_path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(sink_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((st.getPath().getName() for st in fs.listStatus(root)), reverse=True)
    for name in names:
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{sink_path}/{name}/_SUCCESS")):
            return spark.read.parquet(f"{sink_path}/{name}")
    raise FileNotFoundError(f"no finished result in {sink_path}")
