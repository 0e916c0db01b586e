"""Preprocessing fixture of FIXTURES §4.4 and the leakage guard."""

import pytest

from punctual.operators import prep


def test_impute_scale(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    p = prep.fit_impute_scale(df, ["x"]).first()
    assert p.median == 2.5 and abs(p.mean - 3.7) < 1e-12 and abs(p.std - 3.218695) < 1e-6
    got = [round(r.x, 6) for r in prep.apply_impute_scale(df, prep.fit_impute_scale(df, ["x"]), ["x"]).collect()]
    assert got == [-0.838849, -0.528164, -0.217479, 1.957315, -0.372822]


def test_label_encoding_unseen_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    classes = prep.fit_label_encoders(train, ["c"])
    assert sorted((r.value, r.code) for r in classes.collect()) == [("Unknown", 0), ("a", 1), ("b", 2)]
    test = spark.createDataFrame([("zz",), ("b",), (None,)], "c string")
    assert [r.c for r in prep.apply_label_encoders(test, classes, ["c"]).collect()] == [0, 2, 0]


def test_leakage_guard():
    prep.check_no_leakage(["Airline", "DepHour"])
    with pytest.raises(ValueError):
        prep.check_no_leakage(["Airline", "TaxiOut"])
