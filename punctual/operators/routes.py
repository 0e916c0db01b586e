"""Route-distance store (J5/A27): counts of (year, route, distance), kept by batch and year, and medians from them.

Counts are a mergeable state: a batch of flights adds its own counts, in a folder of its own, and nothing that is there
is read or rewritten.  A batch that is written again replaces itself, so a retried or restarted job counts no flight
twice.  A request batch reads only counts, of the routes it asks for: never a flight.  A route that holds a third of all
flights is as many rows as it has distances in a year, counted map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.session import fresh_path

ROUTE = ["Origin", "Dest"]
_SCHEMA = "Origin string, Dest string, Distance double, n long, batch string, Year int"


def route_counts(flights: DataFrame) -> DataFrame:
    """Year, Origin, Dest, Distance, n of flights with a route and a distance."""
    year = F.col("Year") if "Year" in flights.columns else F.year("FlightDate")
    return (flights.where(F.col("Origin").isNotNull() & F.col("Dest").isNotNull() & F.col("Distance").isNotNull())
            .groupBy(year.cast("int").alias("Year"), *ROUTE, F.col("Distance").cast("double").alias("Distance"))
            .agg(F.count(F.lit(1)).alias("n")))


def add_batch(flights: DataFrame, path: str, batch: str) -> None:
    """Add a batch of flights to the store, or write it again."""
    route_counts(flights).write.mode("overwrite").partitionBy("Year").parquet(f"{path}/batch={batch}")


def read_counts(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Merged counts of the store; ``years`` (first, last) prunes folders."""
    rows = spark.read.schema(_SCHEMA).option("basePath", path).parquet(path)
    if years is not None:
        rows = rows.where(F.col("Year").between(*years))
    return rows.groupBy("Year", *ROUTE, "Distance").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str) -> str:
    """A new store with all batches merged into one; returns its path.  The old one stays as it is."""
    new = fresh_path(spark, "route-counts")
    read_counts(spark, path).write.partitionBy("Year").parquet(f"{new}/batch=merged")
    return new


def route_medians(counts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Origin, Dest, route_distance: exact medians (midpoint of the two middle values), of the ``asked`` routes only."""
    if asked is not None:
        counts = counts.join(asked.select(*ROUTE).distinct(), ROUTE, "left_semi")
    return counts.groupBy(*ROUTE).agg(F.percentile("Distance", F.lit(0.5), F.col("n")).alias("route_distance"))


def fill_distance(requests: DataFrame, counts: DataFrame, default: float = 1000.0) -> DataFrame:
    """A request without a distance takes its route's median, else ``default``."""
    med = route_medians(counts, requests.where(F.col("Distance").isNull()))
    return (requests.join(med, ROUTE, "left")
            .withColumn("Distance", F.coalesce(F.col("Distance").cast("double"), "route_distance", F.lit(default)))
            .drop("route_distance"))


def start_route_stream(spark: SparkSession, source_dir: str, schema, path: str, checkpoint: str):
    """Feed the store from flight files as they arrive; every micro-batch is a batch of the store."""
    def write(batch: DataFrame, epoch: int) -> None:
        add_batch(batch, path, f"stream-{epoch:012d}")
    stream = spark.readStream.schema(schema).parquet(source_dir).writeStream.option("checkpointLocation", checkpoint)
    return stream.foreachBatch(write).trigger(availableNow=True).start()
