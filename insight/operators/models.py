"""Features, supervised models and scoring with ``pyspark.ml``.

Model fitting is distributed by Spark ML (tree levels and gradient steps are
aggregations over partitions).  Only model outputs that are bounded by the
feature count (coefficients, importances, feature names) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions.expr import interval_bins
from insight.operators.joins import broadcast_if_small
from insight.operators.ranking import rank_rows


def label_encode_many(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``LabelEncoder`` on several columns with one ranking pass (M1).

    The distinct ``(column, level)`` pairs are numbered per column by the
    distributed exact rank, checked for size once, and joined back per
    column.  Nulls stay null.
    """
    entries = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_l"))
               for i, (c, _) in enumerate(pairs)]
    levels = (df.select(F.explode(F.array(*entries)).alias("_e")).select("_e._c", "_e._l")
              .where(F.col("_l").isNotNull()).distinct())
    codes = broadcast_if_small(rank_rows(levels, [("_l", True)], by=["_c"], rank_col="_r").select(
        "_c", "_l", (F.col("_r") - 1).cast("int").alias("_code")))
    out = df
    for i, (c, name) in enumerate(pairs):
        mine = codes.where(F.col("_c") == i).select(F.col("_l").alias("_lv"), F.col("_code").alias(name))
        out = out.join(mine, out[c].cast("string") == mine["_lv"], "left").drop("_lv")
    return out


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """``LabelEncoder``: codes 0..k-1 in alphabetical order of the values (M1).

    The distinct levels are numbered by the distributed exact rank (no
    single-partition window, however many levels) and joined back behind a
    size check.  Nulls stay null.
    """
    levels = df.where(F.col(col).isNotNull()).select(col).distinct()
    codes = rank_rows(levels, [(col, True)], rank_col="_r").select(
        col, (F.col("_r") - 1).cast("int").alias(out))
    return df.join(broadcast_if_small(codes), on=col, how="left")


def standardise(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None,
                prefix: str = "z_", population: bool = True) -> DataFrame:
    """``StandardScaler`` fitted on the rows where ``fit_on`` holds (M3).

    Mean and population std (scikit-learn's; ``population=False`` gives
    Spark ML's sample std) come from one aggregate, inlined as a scalar.
    A zero std leaves the centred value unscaled, as scikit-learn does.
    """
    src = df.where(fit_on) if fit_on is not None else df
    std = F.stddev_pop if population else F.stddev_samp
    stats = src.select(F.struct(*[F.struct(F.avg(c).alias("m"), std(c).alias("s")).alias(c)
                                   for c in cols])).scalar()
    out = df.withColumn("_st", stats)
    for c in cols:
        m, s = F.col("_st")[c]["m"], F.col("_st")[c]["s"]
        centred = F.col(c).cast("double") - m
        out = out.withColumn(prefix + c, F.when(s > 0, centred / s).otherwise(centred))
    return out.drop("_st")


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def fit_linear(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Ordinary least squares (M4): normal equations, no regularisation."""
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0)
    return Pipeline(stages=[_assembler(features), lr]).fit(train)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str,
                 weight: str | None = None, max_iter: int = 500, c: float = 1.0,
                 tol: float = 1e-8) -> PipelineModel:
    """L2 logistic regression equal to scikit-learn's ``C`` objective (M5, M6).

    scikit-learn minimises ``0.5|w|^2 + C sum(w_i loss_i)``; Spark minimises
    ``sum(w_i loss_i)/sum(w_i) + regParam/2 |w|^2``, so ``regParam =
    1 / (C * sum(w_i))``.  Features are expected standardised already.
    """
    wsum = train.select(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0] or 1
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (c * float(wsum)), elasticNetParam=0.0,
                            standardization=False, tol=tol)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), lr]).fit(train)


def fit_tree(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
             max_depth: int = 6, seed: int = 42) -> PipelineModel:
    """Decision tree (M8); splits are binned (``maxBins``), not exhaustive."""
    dt = DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=max_depth,
                                seed=seed, maxBins=64)
    if weight:
        dt = dt.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), dt]).fit(train)


def fit_forest(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
               num_trees: int = 150, max_depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest with sqrt feature subsets and bootstrap rows (M9)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed,
                                maxBins=64)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), rf]).fit(train)


def score(model: PipelineModel, df: DataFrame, prob: str = "probability_1",
          pred: str = "prediction") -> DataFrame:
    """``predict_proba(...)[:, 1]`` and ``predict`` (threshold 0.5)."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn(prob, vector_to_array("probability")[1])
        out = out.withColumn("_pred", F.col("prediction").cast("int"))
    else:
        out = out.withColumn("_pred", F.col("prediction"))
    out = out.drop("prediction", "probability", "rawPrediction", "features")
    return out.withColumnRenamed("_pred", pred)


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """``feature_importances_`` sorted descending (M17); one row per feature."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    schema = T.StructType([T.StructField("feature", T.StringType(), False),
                           T.StructField("importance", T.DoubleType(), False)])
    return spark.createDataFrame(list(zip(features, [float(v) for v in imp])), schema).orderBy(
        F.col("importance").desc(), "feature")


def risk_tiers(df: DataFrame, score_col: str, edges: Sequence[float], labels: Sequence[str],
               out: str = "risk_tier", include_lowest: bool = False) -> DataFrame:
    """``pd.cut(score, edges, labels)`` on model scores."""
    return df.withColumn(out, interval_bins(score_col, edges, labels, include_lowest=include_lowest))
