"""CSV discovery / lenient load / fail-fast."""

import os
import tempfile

import pytest

from punctual.functions.features import prepare_features
from punctual.sources import files


def _write(d, name, text):
    with open(os.path.join(d, name), "w") as fh:
        fh.write(text)


def test_discover_and_lenient_load(spark):
    d = tempfile.mkdtemp()
    hdr = "FlightDate,Airline,ArrDelayMinutes,Cancelled,CRSDepTime,Distance\n"
    _write(d, "Combined_Flights_2018.csv", hdr + "2018-01-01,AA,5,False,900,300\nx,AA,7,False,900,\n")
    _write(d, "Combined_Flights_2019.csv", hdr + "2019-02-01,BB,NaN,True,1000,500\n")
    _write(d, "sampled_flights_2018_2022.csv", hdr)
    _write(d, "other.csv", hdr)
    paths = files.discover_inputs(spark, d)
    assert [os.path.basename(p) for p in paths] == ["Combined_Flights_2018.csv", "Combined_Flights_2019.csv"]
    df = files.read_flights_csv(spark, files.existing(spark, paths + [os.path.join(d, "gone.csv")]))
    rows = sorted(df.collect(), key=lambda r: str(r.FlightDate))
    assert len(rows) == 3
    bad = [r for r in rows if r.FlightDate is None]
    assert len(bad) == 1 and bad[0].Distance is None
    nan_row = [r for r in rows if r.Airline == "BB"][0]
    assert nan_row.ArrDelayMinutes is None and nan_row.Cancelled is True
    assert "DepDelayMinutes" in df.columns           # absent column added as typed null
    assert prepare_features(df).count() == 2        # invalid date dropped


def test_missing_input_fails_fast(spark):
    with pytest.raises(FileNotFoundError):
        files.load_flight_data(spark, "/nonexistent/sampled.csv")


def test_integers_and_flags_written_with_decimals(spark, tmp_path):
    from punctual.sources.files import read_flights_csv
    path = tmp_path / "f.csv"
    path.write_text("FlightDate,CRSDepTime,Cancelled,Diverted\n1996-01-02,600.0,1.0,0\n1996-01-03,2400,0.0,true\n"
                    "1996-01-04,x,,1\n1996-01-05,6.5,2,False\n")
    rows = read_flights_csv(spark, str(path)).orderBy("FlightDate").collect()
    assert [r.CRSDepTime for r in rows] == [600, 2400, None, None]
    assert [r.Cancelled for r in rows][:3] == [True, False, None]
    assert [r.Diverted for r in rows] == [False, True, True, False]


def test_queries_that_write_can_run_twice_and_for_two_inputs(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    qs = E.queries()
    other = SF_SMALL.replace("0.001", "0.01")
    for name, total in (("stream_daily_delays", "total_flights"), ("write_roundtrip", "rows"), ("load_csv", "rows")):
        first = qs[name](spark, SF_SMALL)
        big = qs[name](spark, other).agg({total: "sum"}).first()[0]
        again = qs[name](spark, SF_SMALL).agg({total: "sum"}).first()[0]
        assert first.agg({total: "sum"}).first()[0] == again < big


def test_stream_restart_goes_on_where_it_stopped(spark, tmp_path):
    from conftest import SF_SMALL
    from punctual.sources.flights import flights
    from punctual.streaming.daily import read_daily, start_daily_stream
    f = flights(spark, SF_SMALL).drop("Year")
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    for half in (0, 1):
        f.filter(f"pmod(crc32(FlightKey), 2) = {half}").write.mode("append").parquet(src)
        start_daily_stream(spark, src, f.schema, sink, state).awaitTermination()
    assert read_daily(spark, sink).agg({"total_flights": "sum"}).first()[0] == f.count()


def test_shared_folder_rules(spark, monkeypatch):
    from punctual import session
    sc = spark.sparkContext
    assert session.checkpoint_dir(spark) == sc.getConf().get("spark.checkpoint.dir")
    assert session.fresh_path(spark, "a") != session.fresh_path(spark, "a")


def test_flights_are_written_by_year_without_exchange_or_sort(spark, tmp_path):
    from pyspark.sql import functions as F
    from punctual.sources.flights import _write_years
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = spark.range(0, 60, 1, 2).withColumn("Year", (1992 + F.col("id") % 3).cast("int"))
    _write_years(rows, str(tmp_path / "f"))
    for year in (1992, 1993, 1994):
        files = [f for f in os.listdir(tmp_path / "f" / f"Year={year}") if f.endswith(".parquet")]
        assert len(files) == 2                      # one of each task
    back = spark.read.parquet(str(tmp_path / "f"))
    assert sorted(map(tuple, back.select("id", "Year").collect())) == [(i, 1992 + i % 3) for i in range(60)]
    assert spark.conf.get(name) == before
