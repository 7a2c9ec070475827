from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freightlens import functions as fn


def values(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


def test_day_difference_rounds_down(spark):
    df = spark.createDataFrame(
        [(datetime(2017, 1, 2, 1), datetime(2017, 1, 2)), (datetime(2017, 1, 1, 1), datetime(2017, 1, 2)),
         (None, datetime(2017, 1, 2))], "a timestamp_ntz, b timestamp_ntz")
    found = values(df, fn.days_between("a", "b"), fn.hours_between("a", "b"))
    assert found == [(0, 1.0), (-1, -23.0), (None, None)]


def test_calendar(spark):
    df = spark.createDataFrame([(datetime(2017, 1, 1, 5),)], "a timestamp_ntz")
    assert values(df, fn.weekday("a"), fn.iso_week("a"), fn.days_left_in_month("a")) == [(6, 52, 30)]


def test_absent_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (inf, 1.0), (nan, 1.0), (-2.0, 4.0)], "x double, y double")
    assert values(df, fn.clean("x"))[2:4] == [(None,), (None,)]
    assert values(df, fn.ratio("x", "y"))[:2] == [(None,), (None,)]
    assert values(df, fn.log1p("x"))[4] == (None,)
    assert values(df, fn.flag(F.col("x") > 0))[1] == (0,)
    assert values(df, fn.clip_upper("x", F.lit(0.5)))[:2] == [(0.5,), (None,)]
    assert values(df, fn.floor_div("x", 3))[4] == (-1,)


def test_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    found = [row[0] for row in values(df, fn.haversine_km("a", "b", "c", "d"))]
    assert found[0] == pytest.approx(3.141592653589793 * 6371.0)
    assert found[1] == 0.0
    assert values(df, fn.direction_code("a", "b", "c", "d"))[0] == (1.0,)
