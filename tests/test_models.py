"""Model fits against numpy solutions (no scikit-learn in the image)."""

import numpy as np
import pytest
import pandas as pd

from insight.operators.models import feature_importance, fit_forest, fit_linear, fit_logistic, label_encode, score, standardise


def test_linear_equals_lstsq(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 3))
    y = X @ np.array([2.0, -1.0, 0.5]) + 3 + rng.normal(0, 0.1, 120)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y)
    m = fit_linear(spark.createDataFrame(pdf), ["a", "b", "c"], "y")
    coef = np.linalg.lstsq(np.c_[X, np.ones(120)], y, rcond=None)[0]
    lr = m.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), coef[:3], atol=1e-6)
    assert abs(lr.intercept - coef[3]) < 1e-6


def _newton_l2_logistic(X, y, w, C=1.0, iters=50):
    Xb = np.c_[X, np.ones(len(X))]
    beta = np.zeros(Xb.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ beta))
        reg = np.r_[beta[:-1], 0.0]
        g = C * Xb.T @ (w * (p - y)) + reg
        H = C * (Xb.T * (w * p * (1 - p))) @ Xb + np.diag(np.r_[np.ones(X.shape[1]), 0.0])
        beta -= np.linalg.solve(H, g)
    return beta


def test_weighted_logistic_equals_newton(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 2))
    y = (X[:, 0] - 0.5 * X[:, 1] + rng.normal(0, 1, 300) > 0.8).astype(float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    pdf = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y, "w": w})
    m = fit_logistic(spark.createDataFrame(pdf), ["a", "b"], "y", weight="w")
    beta = _newton_l2_logistic(X, y, w)
    lr = m.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), beta[:2], atol=1e-4)
    assert abs(lr.intercept - beta[2]) < 1e-4


def test_standardise_population_std(spark):
    from pyspark.sql import functions as F

    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, 10.0], "t": [True, True, True, True, False]})
    z = standardise(spark.createDataFrame(pdf), ["x"]).toPandas()["z_x"].values
    assert np.allclose(z, (pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0))
    fit = pdf.x[pdf.t]  # fitted on the training rows only, applied to all
    z2 = standardise(spark.createDataFrame(pdf), ["x"], fit_on=F.col("t")).toPandas()["z_x"].values
    assert np.allclose(z2, (pdf.x - fit.mean()) / fit.std(ddof=0))


def test_label_encode_alphabetical(spark):
    from insight.operators.models import label_encode_many

    df = spark.createDataFrame([("b", "y"), ("a", "x"), ("c", None), ("a", "z"), (None, "x")], "s string, t string")
    got = {r["s"]: r["code"] for r in label_encode(df, "s", "code").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: None}
    many = label_encode_many(df, [("s", "sc"), ("t", "tc")]).collect()
    assert {(r["s"], r["sc"]) for r in many} == {("a", 0), ("b", 1), ("c", 2), (None, None)}
    assert {(r["t"], r["tc"]) for r in many} == {("x", 0), ("y", 1), ("z", 2), (None, None)}


def test_forest_scores_and_importances(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 3))
    y = (X[:, 0] > 0).astype(float)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y)
    sdf = spark.createDataFrame(pdf)
    m = fit_forest(sdf, ["a", "b", "c"], "y", num_trees=20, max_depth=4)
    s = score(m, sdf).toPandas()
    assert s["probability_1"].between(0, 1).all() and set(s["prediction"]) <= {0, 1}
    imp = feature_importance(m, ["a", "b", "c"], spark).toPandas()
    assert abs(imp["importance"].sum() - 1) < 1e-9 and imp.iloc[0]["feature"] == "a"


@pytest.mark.parametrize("balance_first", [False, True])
def test_oversampled_pipeline_runs_both_orders(spark, balance_first):
    from tablepaths import SF001
    from insight.plans.risk import oversampled_comparison

    rows = oversampled_comparison(spark, SF001, balance_first=balance_first).collect()
    assert [r["model"] for r in rows] == ["Random Forest", "Logistic Regression"]
    for r in rows:
        assert 0.0 <= r["accuracy"] <= 1.0 and (r["auc"] is None or 0.0 <= r["auc"] <= 1.0)
