"""Deterministic splits, oversampling and class weights."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from insight.operators.sampling import balanced_weights, oversample, split


def _labels(spark, n0=100, n1=3):
    pdf = pd.DataFrame({"id": np.arange(n0 + n1, dtype="int64"), "y": [0] * n0 + [1] * n1})
    return spark.createDataFrame(pdf)


def test_split_sizes_and_determinism(spark):
    df = _labels(spark)
    a = split(df, "id", 0.2, 42)
    assert a.where("is_test").count() == 21  # ceil(0.2 * 103)
    b = split(df.repartition(7), "id", 0.2, 42)
    assert sorted(r.id for r in a.where("is_test").collect()) == sorted(r.id for r in b.where("is_test").collect())
    s = split(df, "id", 0.2, 42, stratify="y")
    sizes = {r["y"]: r["n"] for r in s.groupBy("y").agg(F.count_if("is_test").alias("n")).collect()}
    assert sizes == {0: 20, 1: 1}


def test_oversample_exact_size(spark):
    df = _labels(spark)
    up = oversample(df, "y", "id", seed=42)
    counts = {r["y"]: r["count"] for r in up.groupBy("y").count().collect()}
    assert counts == {0: 100, 1: 100}
    drawn = up.where("copy_id > 0")
    assert drawn.select(F.countDistinct("copy_id")).first()[0] == 100
    assert set(r.id for r in drawn.collect()) <= {100, 101, 102}


def test_balanced_weights(spark):
    w = {r["y"]: r["weight"] for r in balanced_weights(_labels(spark), "y").select("y", "weight").distinct().collect()}
    assert abs(w[0] - 103 / 200) < 1e-12 and abs(w[1] - 103 / 6) < 1e-12
