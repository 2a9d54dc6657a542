"""Exact trees and Newton logistic models: brute force, partition counts, compiled forms."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight.operators import newton, trees


def brute_tree(x, y, w, depth, node=1):
    """Splits by node of the greedy tree over all midpoints."""
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if depth == 0 or not n0 or not n1:
        return {}

    def side(a, b):
        return (a + b) - (a * a + b * b) / (a + b)

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[~np.isnan(x[:, f]), f])
        for lo, hi in zip(values, values[1:]):
            left = x[:, f] <= lo
            a, b = int((left & (y == 0)).sum()), int((left & (y == 1)).sum())
            loss = side(a * w[0], b * w[1]) + side((n0 - a) * w[0], (n1 - b) * w[1])
            best = min(best, (loss, f, (lo + hi) / 2)) if best else (loss, f, (lo + hi) / 2)
    whole = side(n0 * w[0], n1 * w[1])
    if best is None or not best[0] < whole - trees.LEAST_GAIN * (n0 * w[0] + n1 * w[1]):
        return {}
    left = x[:, best[1]] <= best[2]
    return {node: best[1:]} | brute_tree(x[left], y[left], w, depth - 1, 2 * node) | brute_tree(x[~left], y[~left], w, depth - 1, 2 * node + 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 6, 400), rng.normal(size=400).round(3), rng.integers(0, 2, 400), np.ones(400)]).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 0.3) ^ (rng.random(400) < 0.1)).astype(int)
    x[::37, 1] = np.nan
    return x, y


@pytest.mark.parametrize("parts,balanced", [(1, False), (8, True)])
def test_tree_against_brute_force(spark, rows, parts, balanced):
    x, y = rows
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y)
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        tree = trees.fit_tree(df, list("abcd"), "y", balanced=balanced, max_depth=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n = np.bincount(y)
    weights = (len(y) / (2.0 * n[0]), len(y) / (2.0 * n[1])) if balanced else (1.0, 1.0)
    assert tree.splits == brute_tree(x, y, weights, 3) and len(tree.splits) > 3
    scored = df.select("*", tree.probability().alias("p")).toPandas()
    con = duckdb.connect()
    con.register("t", scored)
    assert con.execute(f"select max(abs(p - ({tree.sql()}))) from t where b is not null").fetchone()[0] < 1e-12
    assert ((scored.p > 0.5) == scored.y).mean() > 0.8
    share = tree.importances()
    assert abs(sum(share) - 1) < 1e-9 and share[3] == 0 and min(share) >= 0


def test_tree_of_one_class_and_of_no_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    assert trees.fit_tree(df, ["a"], "y").splits == {} and df.select(trees.fit_tree(df, ["a"], "y").probability()).first()[0] == 1.0
    empty = trees.fit_tree(df.limit(0), ["a"], "y")
    assert empty.splits == {} and df.select(empty.probability()).first()[0] == 0.0


def test_newton_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 1, 400) > 0.8).astype(float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y, w=w)).repartition(5)
    model = newton.fit_logistic(df, list("abc"), "y", weight="w", c=0.5)
    at = np.array([model.intercept, *model.coefficients])
    full = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-full @ at))
    assert np.abs(0.5 * full.T @ (w * (p - y)) + np.r_[0.0, at[1:]]).max() < 1e-7  # gradient of the objective
    got = df.select("*", model.probability().alias("p")).toPandas()
    con = duckdb.connect()
    con.register("t", got)
    assert con.execute(f"select max(abs(p - ({model.sql()}))) from t").fetchone()[0] < 1e-12


def test_newton_logistic_of_no_rows_and_null_features(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0), (2.0, 0)], "a double, y int")
    assert newton.fit_logistic(df.limit(0), ["a"], "y").coefficients == (0.0,)
    assert newton.fit_logistic(df, ["a"], "y") == newton.fit_logistic(df.dropna(), ["a"], "y")
