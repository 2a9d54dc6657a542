"""Grouped rates, shares, lifts, pivots and top-k.

All aggregates are ``groupBy().agg()`` with partial (map-side) aggregation;
conditional rates are ``count_if`` over exact counts instead of per-group
Python lambdas; totals used as denominators are scalar subqueries (one small
job, inlined as a literal) rather than single-partition windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight.functions.beta import correlation_p
from insight.functions.expr import comes_after, guarded_ratio, pct_true, round_half_even
from insight.sources.sinks import kpi_table

kpi_long = kpi_table


def rate_by(df: DataFrame, keys: Sequence[str], pred: Column, out: str = "rate_pct",
            count_col: str = "n", hits_col: str | None = None) -> DataFrame:
    """``groupby(keys).apply(lambda x: pred.mean() * 100)`` (A5); null keys dropped."""
    g = df
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    aggs = [F.count(F.lit(1)).alias(count_col)]
    if hits_col:
        aggs.append(F.count_if(pred).alias(hits_col))
    aggs.append(pct_true(pred).alias(out))
    return g.groupBy(*keys).agg(*aggs)


def mean_rate(df: DataFrame, keys: Sequence[str], label: str, out: str = "rate_pct",
              count_col: str = "n") -> DataFrame:
    """``groupby(keys)[label].mean() * 100`` for a 0/1 label (A2)."""
    g = df
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    return g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count_col),
        (F.sum(F.col(label)).cast("double") / F.count(F.col(label)) * F.lit(100.0)).alias(out))


def share_of_total(df: DataFrame, col: str, out: str, digits: int | None = 1) -> DataFrame:
    """``x / x.sum() * 100`` (A6), total as a scalar subquery."""
    total = df.select(F.sum(F.col(col))).scalar()
    share = F.col(col).cast("double") / total.cast("double") * F.lit(100.0)
    return df.withColumn(out, round_half_even(share, digits) if digits is not None else share)


def subset_share(df: DataFrame, value: str, pred: Column) -> Column:
    """``sum(x where pred) / sum(x) * 100`` as an aggregate Column."""
    x = F.col(value)
    return F.sum(F.when(pred, x)).cast("double") / F.sum(x).cast("double") * F.lit(100.0)


def with_group_mean(df: DataFrame, col: str, out: str = "mean_rate", flag: str | None = "above_mean",
                    digits: int | None = 6) -> DataFrame:
    """Unweighted mean of group rates, and an above-mean flag.

    ``df`` is a grouped result (one row per group, e.g. per department), so
    the mean is a window over that small frame rather than a subquery that
    would recompute the grouping.
    """
    m = F.avg(col).over(Window.partitionBy())
    res = df.withColumn(out, round_half_even(m, digits) if digits is not None else m)
    return res.withColumn(flag, F.col(col) > m) if flag else res


def lift(df: DataFrame, pred: Column, label: str) -> DataFrame:
    """Cohort rate against the baseline in one aggregate.

    ``lift = cohort_rate / baseline_rate if baseline_rate > 0 else 0``.
    """
    y = F.col(label)
    base = F.sum(y).cast("double") / F.count(y) * F.lit(100.0)
    size = F.count_if(pred)
    cohort = F.sum(F.when(pred, y)).cast("double") / size * F.lit(100.0)
    one = df.agg(size.alias("cohort_size"), F.count(y).alias("population"),
                 F.when(size > 0, cohort).alias("cohort_rate_pct"), base.alias("baseline_rate_pct"))
    return one.withColumn("lift", guarded_ratio("cohort_rate_pct", "baseline_rate_pct", 0.0))


def ordered_flag(df: DataFrame, col: str, values: Sequence[object], out: str) -> DataFrame:
    """Membership flag for a named set."""
    return df.withColumn(out, F.col(col).isin(*values))


def pivot_agg(df: DataFrame, row_keys: Sequence[str], pivot_col: str, values: Sequence[object],
              agg: Column, names: Sequence[str] | None = None, fill: object | None = None) -> DataFrame:
    """``groupby(rows + [col]).agg().unstack()``.

    The value list is passed explicitly: no extra distinct job, unseen levels
    still get a column, and a null pivot value is dropped.  ``names`` renames
    the value columns; ``fill`` replaces missing cells (``fill_value``).
    """
    g = df.where(F.col(pivot_col).isNotNull())
    for k in row_keys:
        g = g.where(F.col(k).isNotNull())
    p = g.groupBy(*row_keys).pivot(pivot_col, list(values)).agg(agg)
    if names is not None:
        p = p.select(*row_keys, *[F.col(f"`{v}`").alias(n) for v, n in zip(values, names)])
    if fill is not None:
        cols = list(names) if names is not None else [str(v) for v in values]
        p = p.fillna(fill, subset=cols)
    return p


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``sort_values().head(k)`` (T4): TakeOrderedAndProject, k rows per task."""
    return df.orderBy(*order).limit(k)


def arg_max(df: DataFrame, value: str, key: str) -> DataFrame:
    """Row with the largest ``value``, ties to the smallest ``key``."""
    return df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(1)


def top_k_flag(df: DataFrame, value: str, key: str, k: int, out: str, descending: bool = True) -> DataFrame:
    """Flag the first k rows by ``value`` then ``key``.

    The k-th row is found from a top-k (TakeOrderedAndProject, bounded by k)
    and returned as a scalar subquery; every row is then compared with it, so
    the table itself is never sorted into one partition.
    """
    v, kk = F.col(value), F.col(key)
    head = df.select(v.alias("_v"), kk.alias("_k")).orderBy(
        F.col("_v").desc() if descending else F.col("_v").asc(), F.col("_k").asc()).limit(k)
    last = head.orderBy(F.col("_v").asc() if descending else F.col("_v").desc(),
                        F.col("_k").desc()).limit(1).select(
        F.struct(F.col("_v").alias("v"), F.col("_k").alias("k"))).scalar()
    after = comes_after([v, kk], [last["v"], last["k"]], [not descending, True])
    return df.withColumn(out, F.coalesce(~after, F.lit(False)))


def label_correlation(df: DataFrame, cols: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """``|pointbiserialr(x, label)|`` and its two-sided p-value per column, sorted.

    Point-biserial equals Pearson with a 0/1 label: one ``agg`` of ``corr``
    and counts, unpivoted with ``stack``; the p-value is a Column on the result.
    """
    y = F.col(label).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"_r{i}") for i, c in enumerate(cols)],
                 *[F.count(F.when(F.col(c).isNotNull(), y)).alias(f"_n{i}") for i, c in enumerate(cols)])
    longf = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_r{i}").alias("r"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(cols)])))
    return longf.select("feature", round_half_even(F.abs("r"), digits).alias("abs_corr"),
                        round_half_even(correlation_p(F.col("r"), F.col("n")), digits).alias("p_value")).orderBy(
        F.col("abs_corr").desc(), "feature")


def rates_long(df: DataFrame, scales: Sequence[str], label: str, digits: int | None = None) -> DataFrame:
    """Label rate by each level of several scales, as one long frame (A2 x n).

    One aggregate over (scale, level) after an ``explode`` of the scale
    values, instead of n separate passes.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(s).cast("long").alias("level")) for s in scales]))
    exploded = df.select(pairs.alias("p"), F.col(label).alias("_y")).select("p.scale", "p.level", "_y")
    g = exploded.where(F.col("level").isNotNull()).groupBy("scale", "level").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("_y").cast("double") / F.count("_y") * F.lit(100.0)).alias("rate_pct"))
    if digits is not None:
        g = g.withColumn("rate_pct", round_half_even("rate_pct", digits))
    return g
