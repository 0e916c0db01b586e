"""End-to-end dataset build: sample CSV, then train / test files."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from punctual.plans import pipeline as PL
from punctual.schema import TARGET
from punctual.session import scratch_path
from punctual.sources import files


def test_build_and_reload(spark):
    out = scratch_path(spark, "test_build")
    csv = PL.write_sample(spark, SF_SMALL, out)
    back = files.load_flight_data(spark, csv)
    assert back.count() == PL.sampled_flights(spark, SF_SMALL).count()
    paths = PL.write_datasets(spark, SF_SMALL, out)
    train, test = spark.read.parquet(paths["train"]), spark.read.parquet(paths["test"])
    key = ["FlightKey", "FlightDate", "CRSDepTime", "TaxiOut"]
    assert train.join(test, key, "left_semi").count() == 0          # no test rows leak into train
    c = {r[TARGET]: r["count"] for r in train.groupBy(TARGET).count().collect()}
    assert c[1] <= c[0] and c[1] > 0
    assert test.filter(F.col(TARGET).isNull()).count() == 0
