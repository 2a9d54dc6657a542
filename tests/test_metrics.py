"""Metrics against brute-force numpy versions."""

import numpy as np
import pandas as pd

from insight.operators.metrics import (auc_exact, classification_report, confusion, regression_metrics,
                                       roc_points)


def _scores(n=400, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) * 0.6 + y * 0.3, 2)  # rounded: many tied scores across labels
    return pd.DataFrame({"y": y.astype("int64"), "s": s})


def _pairs_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def test_auc_exact_equals_all_pairs(spark):
    pdf = _scores()
    got = auc_exact(spark.createDataFrame(pdf), "y", "s").first()
    assert abs(got["auc"] - _pairs_auc(pdf["y"].values, pdf["s"].values)) < 1e-12
    one = auc_exact(spark.createDataFrame(pdf.assign(y=1)), "y", "s").first()
    assert one["auc"] is None  # a single class has no AUC


def test_roc_points_cumulative(spark):
    pdf = _scores(200, 3)
    got = roc_points(spark.createDataFrame(pdf), "y", "s").toPandas()
    got = got.sort_values("fp", kind="stable").sort_values("tp", kind="stable")
    pts = sorted(zip(got["threshold"].fillna(np.inf), got["tp"], got["fp"]), key=lambda t: -t[0])
    for thr, tp, fp in pts:
        if np.isinf(thr):
            assert (tp, fp) == (0, 0)
            continue
        assert tp == int(((pdf["s"] >= thr) & (pdf["y"] == 1)).sum())
        assert fp == int(((pdf["s"] >= thr) & (pdf["y"] == 0)).sum())


def test_confusion_and_report(spark):
    pdf = _scores(300, 9)
    pdf["p"] = (pdf["s"] >= 0.5).astype("int64")
    sdf = spark.createDataFrame(pdf)
    cm = {r["label"]: (r["pred_0"], r["pred_1"]) for r in confusion(sdf, "y", "p").collect()}
    for k in (0, 1):
        assert cm[k] == (int(((pdf.y == k) & (pdf.p == 0)).sum()), int(((pdf.y == k) & (pdf.p == 1)).sum()))
    rep = classification_report(sdf, "y", "p").toPandas().set_index("class")
    for k in (0, 1):
        tp = ((pdf.y == k) & (pdf.p == k)).sum()
        prec, rec = tp / (pdf.p == k).sum(), tp / (pdf.y == k).sum()
        assert abs(rep.loc[str(k), "precision"] - prec) < 1e-6
        assert abs(rep.loc[str(k), "recall"] - rec) < 1e-6
        assert abs(rep.loc[str(k), "f1"] - 2 * prec * rec / (prec + rec)) < 1e-6
    assert rep.loc["weighted avg", "support"] == len(pdf)


def test_regression_metrics(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(100, 20, 150)
    p = y + rng.normal(0, 10, 150)
    got = regression_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(got["r2"] - r2) < 1e-6 and abs(got["mae"] - np.abs(y - p).mean()) < 1e-6
    assert got["lo"] == round(min(y.min(), p.min()), 6) and got["hi"] == round(max(y.max(), p.max()), 6)
