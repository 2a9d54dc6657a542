"""Profiling and cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions.expr import round_half_even
from insight.operators.joins import join_group_stat
from insight.operators.ranking import grouped_quantiles, quantile_values, quantile_values_multi

_FLOATING = (T.FloatType, T.DoubleType)


def _is_null(df: DataFrame, c: str):
    col = F.col(c)
    if isinstance(df.schema[c].dataType, _FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def profile(df: DataFrame, keys: Sequence[str], stage: str | None = None) -> DataFrame:
    """Rows, columns, null cells and duplicate keys in one aggregate.

    Null cells count null and NaN (``isnull().sum().sum()``); duplicate keys
    are ``rows - distinct keys`` where a key containing nulls still counts.
    """
    nulls = reduce(lambda a, b: a + b, [F.count_if(_is_null(df, c)) for c in df.columns])
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        nulls.alias("null_cells"),
        F.count_distinct(F.struct(*[F.col(k) for k in keys])).alias("_dk"),
    )
    out = one.select(
        F.col("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
        F.col("null_cells"), (F.col("rows") - F.col("_dk")).alias("duplicate_keys"))
    return out.select(F.lit(stage).alias("stage"), "*") if stage is not None else out


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``drop_duplicates(keys)`` keeping the first row in ``order_by`` order.

    Written as ``min(struct(order_by..., rest...))`` per key: a partial +
    final aggregate, so a key with a third of all rows is collapsed to one
    row per map task before the shuffle (a ``row_number`` window would sort
    that whole key inside one task).  Rows equal on every column are one.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(c) for c in order_by + rest]).alias("_first")
    out = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order_by + rest]).select(*df.columns)


def impute_median(df: DataFrame, col: str, by: Sequence[str] | None = None,
                  out: str | None = None) -> DataFrame:
    """``fillna(median)`` globally (C3) or per group (C4, ``transform('median')``).

    Exact medians from counts per distinct value (no task holds all values;
    any number of groups).  The per-group medians are joined back behind a
    size check.  A group that is all null stays null; a null group key is not
    imputed (pandas drops null keys in ``groupby``).  Runs jobs at build time.
    """
    out = out or col
    if not by:
        med = F.element_at(quantile_values(df, col, [0.5]), 1)
        return df.withColumn("_med", med).withColumn(
            out, F.coalesce(F.col(col).cast("double"), F.col("_med"))).drop("_med")
    by = list(by)
    stats = grouped_quantiles(df, col, by, [0.5]).select(*by, F.col("_q")[0].alias("_med"))
    return join_group_stat(df, stats, by).withColumn(
        out, F.coalesce(F.col(col).cast("double"), F.col("_med"))).drop("_med")


def describe(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """``df.describe().round(digits)`` in long form, one row per column.

    count, mean, sample std, min, exact 25/50/75% (interpolated, like pandas)
    and max.  All columns share one aggregate pass and one pass of value
    counts for the quartiles (not ``summary()``, whose quartiles are
    approximate); the wide result is unpivoted with ``inline``.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"_n{i}"), F.avg(x).alias(f"_a{i}"),
                 F.stddev_samp(x).alias(f"_s{i}"), F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    one = df.agg(*aggs).withColumn("_q", quantile_values_multi(df, cols, [0.25, 0.5, 0.75]))

    def r(e):
        return round_half_even(e, digits)

    rows = []
    for i, c in enumerate(cols):
        q = F.try_element_at(F.col("_q"), F.lit(i))
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("count"), r(F.col(f"_a{i}")).alias("mean"),
            r(F.col(f"_s{i}")).alias("std"), r(F.col(f"_lo{i}")).alias("min"),
            r(F.element_at(q, 1)).alias("p25"), r(F.element_at(q, 2)).alias("p50"),
            r(F.element_at(q, 3)).alias("p75"), r(F.col(f"_hi{i}")).alias("max")))
    return one.select(F.inline(F.array(*rows)))
