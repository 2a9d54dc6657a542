"""Profiling and cleaning operators against pandas."""

import numpy as np
import pandas as pd

from insight.operators.clean import dedupe, describe, impute_median, profile


def test_dedupe_keeps_first_in_order(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (2, 5, "x"), (2, 5, "x"), (3, 9, "z")]
    df = spark.createDataFrame(rows, "k long, o long, v string")
    got = sorted(tuple(r) for r in dedupe(df, ["k"], ["o"]).collect())
    assert got == [(1, 1, "a"), (2, 5, "x"), (3, 9, "z")]
    assert dedupe(df, ["k"], ["o"]).columns == ["k", "o", "v"]


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "a", float("nan")), (2, "b", 3.0)], "k long, s string, x double")
    r = profile(df, ["k"], "raw").first()
    assert (r["stage"], r["rows"], r["columns"], r["null_cells"], r["duplicate_keys"]) == ("raw", 3, 3, 2, 1)


import pytest


def test_impute_median_global_and_grouped(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("a", 4.0), ("b", None), ("b", None), (None, None), ("c", 10.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    glob = [r["y"] for r in impute_median(df, "x", out="y").collect()]
    assert glob == pdf["x"].fillna(pdf["x"].median()).tolist()
    grp = impute_median(df, "x", by=["g"], out="y").toPandas().sort_values(["g", "x"], na_position="last")
    exp = pdf.assign(y=pdf["x"].fillna(pdf.groupby("g")["x"].transform("median"))).sort_values(["g", "x"], na_position="last")
    assert [None if pd.isna(v) else v for v in grp["y"]] == [None if pd.isna(v) else v for v in exp["y"]]


def test_describe_like_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(10, 3, 201).round(2), "b": rng.integers(0, 50, 201).astype(float)})
    got = describe(spark.createDataFrame(pdf), ["a", "b"]).toPandas().set_index("column_name")
    exp = pdf.describe().round(2)
    for c in ["a", "b"]:
        assert got.loc[c, "count"] == exp.loc["count", c]
        for s, e in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                     ("p75", "75%"), ("max", "max")]:
            assert abs(got.loc[c, s] - exp.loc[e, c]) < 1e-9, (c, s)
