"""Scalar expressions: clip, bins, rounding, bands, ratios and time parts."""

import datetime as dt
import math

import pandas as pd
from pyspark.sql import functions as F

from insight.functions import (band, clip, day_index, day_name, guarded_ratio, interval_bins,
                               is_weekend, month_label, month_start, round_half_even,
                               whole_days_between)
from insight.operators.rfm import SEGMENT_DEFAULT, SEGMENT_THRESHOLDS


def test_clip_keeps_null_and_maps_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (10.0,), (50.0,), (70.0,), (50000.0,), (60000.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 50.0, 50000.0)).collect()]
    assert got[0] is None and got[1] is None
    assert got[2:] == [50.0, 50.0, 70.0, 50000.0, 50000.0]


def test_interval_bins_right_closed_left_open(spark):
    vals = [0.0, 0.1, 0.33, 0.3300001, 0.66, 0.7, 1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    labels = ["a", "b", "c"]
    got = [r[0] for r in df.select(interval_bins("x", [0, 0.33, 0.66, 1.0], labels)).collect()]
    assert got == [None, "a", "a", "b", "b", "c", "c", None]
    inc = [r[0] for r in df.select(interval_bins("x", [0, 0.33, 0.66, 1.0], labels, include_lowest=True)).collect()]
    assert inc[0] == "a"


def test_round_half_even_like_pandas(spark):
    vals = [2.25, 2.35, 0.15, 8.65, -2.25, 1234.5678]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 1)).collect()]
    assert got == pd.Series(vals).round(1).tolist()


def test_band_first_match(spark):
    df = spark.createDataFrame([(s,) for s in [3, 4, 7, 10, 13, 15]], "s int")
    got = [r[0] for r in df.select(band("s", SEGMENT_THRESHOLDS, SEGMENT_DEFAULT)).collect()]
    best_first = [label for _, label in SEGMENT_THRESHOLDS]
    assert got == [SEGMENT_DEFAULT, *best_first[::-1], best_first[0]]


def test_guarded_ratio_zero_baseline(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(guarded_ratio("a", "b")).collect()] == [0.0, 0.25]


def test_time_parts(spark):
    rows = [(dt.datetime(2024, 1, 6, 10), dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 3, 1)),
            (dt.datetime(2024, 1, 7, 0), dt.datetime(2024, 1, 31, 0), dt.datetime(2024, 2, 1, 0)),
            (dt.datetime(2024, 1, 8, 0), dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 0))]
    df = spark.createDataFrame(rows, "t timestamp_ntz, a timestamp_ntz, b timestamp_ntz")
    got = df.select(day_name("t"), day_index("t"), is_weekend("t"), month_start("a"), month_label("a"),
                    whole_days_between("a", "b")).collect()
    assert [r[0] for r in got] == ["Saturday", "Sunday", "Monday"]
    assert [r[1] for r in got] == [5, 6, 0]
    assert [r[2] for r in got] == [True, True, False]
    assert got[0][3] == dt.date(2024, 1, 1) and got[0][4] == "Jan 2024"
    assert [r[5] for r in got] == [1, 1, 0]  # 23:00 to 01:00 two days on is one whole day


def test_no_python_udf_in_plans(spark):
    df = spark.createDataFrame([(1.0,)], "x double").select(clip("x", 0, 1), round_half_even("x", 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert not math.isnan(df.first()[0])


def test_rates_over_empty_input_are_null(spark):
    from insight.functions.expr import pct_true

    empty = spark.createDataFrame([], "x double")
    assert empty.agg(pct_true(F.col("x") > 0).alias("r")).first()["r"] is None
