"""Evaluation metrics on (label, score / prediction) frames.

All metrics are aggregates over the scored rows; nothing is collected.
AUC is exact (Mann-Whitney with average ranks for ties) from per-score
counts and a distributed prefix count, not the 1000-bin evaluator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.functions.expr import round_half_even
from insight.operators.ranking import prefix_sums


def regression_metrics(df: DataFrame, label: str, pred: str, digits: int | None = 6) -> DataFrame:
    """R2 and MAE (M11) plus common plot bounds of actual and predicted."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    ss_res = F.sum((y - p) * (y - p))
    ss_tot = F.var_pop(y) * F.count(y)  # one pass, by Spark's stable update of the variance
    one = df.agg(
        F.when(ss_tot > 0, F.lit(1.0) - ss_res / ss_tot).otherwise(F.lit(0.0)).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"), F.count(F.lit(1)).alias("n"),
        F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi"))
    if digits is None:
        return one
    return one.select(*[round_half_even(c, digits).alias(c) if c != "n" else F.col(c)
                        for c in one.columns])


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation)."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(score).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def auc_exact(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC = (2 * sum of positive average ranks - P(P+1)) / (2 P N).

    Per distinct score s with c_s rows, ``below_s`` rows score lower; the
    average rank of its rows is ``below_s + (c_s + 1) / 2``.  ``below_s`` is
    a distributed prefix sum over the distinct scores.  Integer arithmetic
    (decimal(38,0)) until the single final division.
    """
    cnt = score_counts(df, label, score).withColumn("c", F.col("pos") + F.col("neg"))
    cum = prefix_sums(cnt, [(score, True)], ["c"])
    below = F.col("c_cum") - F.col("c")
    twice = (F.col("pos").cast("decimal(38,0)")
             * (F.lit(2) * below + F.col("c") + F.lit(1)).cast("decimal(38,0)"))
    one = cum.agg(F.sum(twice).alias("_s2"), F.sum("pos").alias("positives"),
                  F.sum("neg").alias("negatives"))
    p, n = F.col("positives").cast("decimal(38,0)"), F.col("negatives").cast("decimal(38,0)")
    auc = (F.col("_s2") - p * (p + F.lit(1))).cast("double") / (F.lit(2.0) * (p * n).cast("double"))
    return one.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), auc).alias("auc"),
                      "positives", "negatives")


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC curve points per distinct threshold, highest first, plus (0, 0).

    ``tp``/``fp`` are the positives/negatives scoring at or above the
    threshold (distributed prefix sums in descending score order).
    """
    cnt = score_counts(df, label, score)
    cum = prefix_sums(cnt, [(score, False)], ["pos", "neg"])
    tot = cnt.select(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    pts = cum.select(F.col(score).cast("double").alias("threshold"),
                     F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"))
    origin = cnt.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"))
    allp = pts.unionByName(origin).withColumn("_t", tot)
    return allp.select(
        "threshold", "tp", "fp",
        F.when(F.col("_t.p") > 0, F.col("tp") / F.col("_t.p")).alias("tpr"),
        F.when(F.col("_t.n") > 0, F.col("fp") / F.col("_t.n")).alias("fpr"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Label x prediction counts; classes 0 and 1 always have a row."""
    y, p = F.col(label), F.col(pred)
    one = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    kind = df.schema[label].dataType
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(a).cast(kind).alias("label"), F.col(f"c{a}0").alias("pred_0"), F.col(f"c{a}1").alias("pred_1")) for a in (0, 1)])))


def accuracy(label: Column, pred: Column) -> Column:
    """``accuracy_score`` as an aggregate."""
    return F.avg(F.when(label == pred, 1.0).otherwise(0.0))


def classification_report(df: DataFrame, label: str, pred: str, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted averages.

    Zero denominators give 0, as scikit-learn's ``zero_division`` default
    reports (with a warning).  Classes are 0 and 1.
    """
    y, p = F.col(label), F.col(pred)
    one = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for k, other in ((0, 1), (1, 0)):
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{other}{k}"), F.col(f"c{k}{other}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        rows.append((str(k), prec, rec, tp + fn))
    exprs = []
    for name, prec, rec, sup in rows:
        f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(0.0)
        exprs.append(F.struct(F.lit(name).alias("class"), prec.cast("double").alias("precision"),
                              rec.cast("double").alias("recall"), f1.alias("f1"),
                              sup.cast("long").alias("support")))
    per = one.select(F.inline(F.array(*exprs)))
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").alias("support"))
    w = F.col("support").cast("double")
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * w) / F.sum(w)).alias("precision"),
                       (F.sum(F.col("recall") * w) / F.sum(w)).alias("recall"),
                       (F.sum(F.col("f1") * w) / F.sum(w)).alias("f1"),
                       F.sum("support").alias("support"))
    allr = per.unionByName(macro).unionByName(weighted)
    return allr.select("class", *[round_half_even(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                       "support")
