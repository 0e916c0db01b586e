"""Flight records derived from the star-schema test tables.

The test data is a TPC-H-like star schema.  ``flights_view`` turns it into one
flight record per line item (see SURVEY §7.2 for the exact rule); every query
in the package runs over that view, so its work grows with ``lineitem``.

Scale notes
-----------
* ``orders`` is joined to ``customer`` first and the narrow result (order key,
  customer nation) joins ``lineitem`` on the order key: at 100 TB both sides
  are large, so Catalyst plans a sort-merge join; we do not hint it.
* ``customer``/``supplier``/``part`` grow with the scale factor too, so they
  are joined without a broadcast hint.  Catalyst broadcasts them only while
  the planner's size estimate is under ``spark.sql.autoBroadcastJoinThreshold``
  (a checked size), and AQE can switch to a broadcast at runtime.
* ``nation`` has exactly 25 rows by definition of the schema, so it is the only
  side we broadcast explicitly.
* The fact scan is spread over the task slots only when the files yield fewer
  splits than slots (a single-row-group file); at scale this never triggers.
* ``flights`` writes the view once to the shared checkpoint folder, partitioned
  by year.  That cuts lineage (a lost executor re-reads parquet instead of
  re-running five joins) and gives later year filters partition pruning.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.session import fresh_path, scratch_path

STAR_TABLES = ["lineitem", "orders", "customer", "supplier", "part", "nation"]
# Columns that make a flight row unique at every scale (FlightKey alone is not).
ROW_KEY = ["FlightKey", "FlightDate", "CRSDepTime", "TaxiOut"]

#: Years whose files one task writes at the same time.
YEARS_OPEN = 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _hhmm(minutes: F.Column) -> F.Column:
    return (F.floor(minutes / 60) * 100 + minutes % 60).cast("int")


def _estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes x projection; no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _broadcast_threshold(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def flights_view(spark: SparkSession, sf_dir: str, marks: dict[str, Column] | None = None) -> DataFrame:
    """Lazy flights view over the star schema (no materialisation).

    ``marks`` are conditions on FlightKey, FlightDate and Year by name: a line item that meets none is dropped before the
    joins, and each is found once and added to the view as a column."""
    marks = marks or {}
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in
                             ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]])
    day = F.col("l_shipdate").cast("date")
    if marks:
        li = li.withColumns({"FlightKey": key, "FlightDate": day, "Year": F.year(day)}).withColumns(marks) \
            .filter(" OR ".join(marks)).drop("FlightKey", "FlightDate", "Year")
    # A fact file stored as one unsplittable row group scans as a single task,
    # which would run the whole star join serially.  Only then spread it out;
    # a large fact table already has at least as many splits as task slots.
    slots = spark.sparkContext.defaultParallelism
    if li.rdd.getNumPartitions() < slots:
        li = li.repartition(slots)
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    origin = F.broadcast(na.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("Origin")))
    dest = F.broadcast(na.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("Dest")))

    # orders x customer first: both are smaller than lineitem, and the result
    # (order key -> customer nation) is then joined once on the order key, so
    # the lineitem stream is shuffled for three joins instead of four.
    oc = od.join(cu, od.o_custkey == cu.c_custkey).select("o_orderkey", "c_nationkey")
    # Keep the fact table on the probe side: (order -> nation) has one row per
    # order, so the projected orders scan bounds its size (Catalyst's own join
    # estimate multiplies input sizes).  Broadcast it only under the broadcast
    # threshold; otherwise it is a sort-merge join.
    oc = F.broadcast(oc) if _estimated_bytes(od) <= _broadcast_threshold(spark) else oc
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
           .join(su, F.col("l_suppkey") == su.s_suppkey)
           .join(pa, F.col("l_partkey") == pa.p_partkey)
           .join(origin, "s_nationkey")
           .join(dest, "c_nationkey"))

    h = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * 7) % 1000
    dep_min = (F.col("l_orderkey") * 13 + F.col("l_linenumber") * 101) % 1440
    distance = (F.lit(100) + (F.col("s_nationkey") * 977 + F.col("c_nationkey") * 613) % 2900).cast("int")
    b = j.select(
        key.alias("FlightKey"),
        day.alias("FlightDate"),
        F.col("p_brand").alias("Airline"),
        "Origin", "Dest",
        (F.lit(10000) + F.col("s_nationkey")).cast("int").alias("OriginAirportID"),
        (F.lit(10000) + F.col("c_nationkey")).cast("int").alias("DestAirportID"),
        F.col("l_orderkey").alias("FlightNumber"),
        "s_nationkey",
        h.alias("h"), dep_min.alias("dep_min"), distance.alias("Distance"),
        F.col("l_quantity").cast("int").alias("TaxiOut"),
        (F.col("l_linenumber") * 2).cast("int").alias("TaxiIn"),
        *marks,
    )
    c = b.select(
        "*",
        ((F.col("dep_min") + 40 + F.floor(F.col("Distance") / 8)) % 1440).alias("arr_min"),
        F.when(F.col("h") % 50 == 0, 1).otherwise(0).alias("Cancelled"),
        F.when(F.col("h") % 97 == 0, 1).otherwise(0).alias("Diverted"),
        F.floor((F.col("h") * 7 + F.floor(F.col("dep_min") / 60) * 100 + F.col("s_nationkey") * 40) / 10).alias("sc"),
    )
    h_, sc = F.col("h"), F.col("sc")
    dly = (F.when(sc < 150, -1 - h_ % 20).when(sc < 400, 0).when(sc < 720, 1 + h_ % 15)
            .when(sc < 880, 16 + h_ % 45).when(sc < 960, 61 + h_ % 120).otherwise(181 + h_ % 300))
    e = c.select("*", dly.alias("dly"))
    cancelled = F.col("Cancelled") == 1
    gone = cancelled | (F.col("Diverted") == 1)
    pos = F.greatest(F.col("dly"), F.lit(0))
    return e.select(
        "FlightKey", "FlightDate", "Airline", "Origin", "Dest", "OriginAirportID", "DestAirportID",
        "FlightNumber",
        _hhmm(F.col("dep_min")).alias("CRSDepTime"),
        _hhmm(F.col("arr_min")).alias("CRSArrTime"),
        "Distance", "TaxiOut", "TaxiIn",
        F.col("Cancelled").cast("int").alias("Cancelled"),
        F.col("Diverted").cast("int").alias("Diverted"),
        F.when(cancelled, None).otherwise(F.col("dly") + h_ % 7 - 3).cast("double").alias("DepDelayMinutes"),
        F.when(gone, None).otherwise(F.col("dly")).cast("double").alias("ArrDelayMinutes"),
        F.when(cancelled, None).otherwise(_hhmm((F.col("dep_min") + pos) % 1440)).alias("DepTime"),
        F.when(gone, None).otherwise(_hhmm((F.col("arr_min") + pos) % 1440)).alias("ArrTime"),
        (F.least(F.lit(999), F.floor(sc * 6 / 10) + (h_ * 389) % 400).cast("double") / 1000).alias("Score"),
        *marks,
    )


def line_items_by_year(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    """Line items by year of shipment (one column read, a row for each year): about the flights of that year, which lack
    line items without partners."""
    years = read_table(spark, sf_dir, "lineitem").groupBy(F.year(F.col("l_shipdate").cast("date")).alias("y")).count()
    return {r["y"]: r["count"] for r in years.collect() if r["y"] is not None}


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Hash of input paths, sizes and modification times (metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for t in STAR_TABLES:
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{t}.parquet"))
        fs = p.getFileSystem(conf)
        files = fs.listFiles(p, True)   # nested folders count
        while files.hasNext():
            st = files.next()
            parts.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(parts)).encode()).hexdigest()[:16]


_MATERIALISED: dict[tuple[str, str], str] = {}
_LOCK = threading.Lock()


def flights(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Flights table for ``sf_dir``.

    With ``materialize`` the view is written once per input fingerprint to the
    shared checkpoint folder (parquet, partitioned by year) and read back with
    its ``Year`` partition column; the later queries then scan a plain fact
    table with pushdown and partition pruning.
    """
    if not materialize:
        return flights_view(spark, sf_dir)
    with _LOCK:
        path = _materialise(spark, sf_dir)
    # ``Year`` is the partition column: filters on it prune whole folders.
    return spark.read.parquet(path)


def _write_years(flights: DataFrame, path: str) -> None:
    """Write ``flights`` partitioned by year: each task writes a file for each of its years.

    The wide rows are neither dealt out by year nor sorted: a task keeps the files of up to ``YEARS_OPEN`` years open at
    once.  Further years of a task would be sorted, as Spark does without the setting.
    """
    conf, name = flights.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, YEARS_OPEN)
    try:
        flights.write.partitionBy("Year").parquet(path)
    finally:
        conf.set(name, before)


def _materialise(spark: SparkSession, sf_dir: str) -> str:
    """Write the view unless this input has been written; the fingerprint is taken anew on every call."""
    mark = fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, mark)
    path = _MATERIALISED.get(key)
    if path is None:
        path = scratch_path(spark, f"flights-{mark}")
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))):
            # written aside, so two applications that start together never write into one folder
            own = fresh_path(spark, f"flights-{mark}")
            _write_years(flights_view(spark, sf_dir).withColumn("Year", F.year("FlightDate")), own)
            if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(own), target):
                path = own
        _MATERIALISED[key] = path
    return path
