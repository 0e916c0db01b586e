"""File sources and sinks for raw flight records.

* Input discovery lists file *metadata* through the Hadoop FileSystem API (no
  driver-side reading of data); the files themselves are one multi-path
  ``spark.read.csv`` whose splits are the "chunks".
* CSV is read with every column as a string and then cast by *name* to the
  fixed schema with ``try_cast``: no schema-inference pass over the data,
  column order in the files does not matter, unparseable values become null
  (the reference's ``errors='coerce'``), and absent columns are added as typed
  nulls.  NaN never survives into numeric columns.
* Sinks write parquet partitioned by year (or CSV when asked), overwriting.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions.features import lenient_date
from punctual.schema import FLIGHTS, ensure_columns

SAMPLED_NAME = "sampled_flights"
SOURCE_PREFIX = "Combined"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def require_path(spark: SparkSession, path: str, hint: str = "") -> str:
    """Fail fast with FileNotFoundError when an input is missing."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} not found.{(' ' + hint) if hint else ''}")
    return path


def discover_inputs(spark: SparkSession, data_dir: str, prefix: str = SOURCE_PREFIX,
                    suffix: str = ".csv", exclude: tuple[str, ...] = (SAMPLED_NAME,)) -> list[str]:
    """Sorted input paths named ``prefix*suffix``, excluding our own outputs."""
    require_path(spark, data_dir, "Put the yearly source files there first.")
    p, fs = _fs(spark, data_dir)
    names = sorted(st.getPath().getName() for st in fs.listStatus(p))
    out = [os.path.join(data_dir, n) for n in names
           if n.startswith(prefix) and n.endswith(suffix) and not any(n.startswith(e) for e in exclude)]
    if not out:
        raise RuntimeError(f"No source files matching {prefix}*{suffix} in {data_dir}")
    return out


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """S3: keep the paths that exist (missing yearly files are skipped)."""
    out = []
    for path in paths:
        p, fs = _fs(spark, path)
        if fs.exists(p):
            out.append(path)
    return out


def read_flights_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType = FLIGHTS,
                     with_source: bool = True) -> DataFrame:
    """Raw CSV rows -> fixed schema, lenient dates, NaN -> null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for c in raw.columns:
        if c not in types:
            cols.append(F.col(f"`{c}`"))
        elif c == "FlightDate":
            cols.append(lenient_date(F.col(c)).alias(c))
        elif isinstance(types[c], (T.DoubleType, T.FloatType)):
            v = F.col(c).try_cast(types[c])
            cols.append(F.nanvl(v, F.lit(None).cast(types[c])).alias(c))
        elif isinstance(types[c], T.BooleanType):
            # flags come as words, or as 0/1 that became 0.0/1.0 beside a missing value
            number = F.col(c).try_cast("double")
            cols.append(F.coalesce(F.when(number.isin(0.0, 1.0), number == 1), F.col(c).try_cast("boolean")).alias(c))
        elif isinstance(types[c], (T.IntegerType, T.LongType)):
            # an integer column with a missing value is written with decimals (600.0)
            number = F.col(c).try_cast("double")
            cols.append(F.coalesce(F.col(c).try_cast(types[c]),
                                   F.when(number == F.floor(number), number.try_cast(types[c]))).alias(c))
        else:
            cols.append(F.col(c).try_cast(types[c]).alias(c))
    if with_source:
        cols.append(F.input_file_name().alias("source_file"))
    out = raw.select(*cols)
    return ensure_columns(out, T.StructType([f if f.name != "FlightDate" else T.StructField("FlightDate", T.DateType())
                                             for f in schema.fields]))


def load_flight_data(spark: SparkSession, path: str) -> DataFrame:
    """The sampled dataset; raises with a hint when it has not been built."""
    require_path(spark, path, "Build it first with the sampling step.")
    return read_flights_csv(spark, path, with_source=False)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("Year",)) -> str:
    """Overwrite ``path`` with ``df`` (parquet partitioned by year, or CSV with a header)."""
    w = df.write.mode("overwrite")
    parts = [c for c in partition_by if c in df.columns]
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path
