"""Distinct counts that can be added up (A9): a sketch per cell, stored and unioned upwards.

An exact distinct count of a coarser cell cannot be had from those of finer cells; a sketch can.  Cells are
summarised once (hash aggregation, a few kilobytes a cell whatever its rows), and every roll-up reads the cells only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a sketch's registers; the standard error is about 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12


def distinct_cells(df: DataFrame, keys: Sequence[str], col: str, lg_k: int = LG_K) -> DataFrame:
    """``keys``, ``rows`` and the sketch of ``col`` (int, long, string or binary; nulls not counted) per cell."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(col, lg_k).alias("sketch"))


def union_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of ``keys`` (none: the total) from finer ones, in the form of ``distinct_cells``."""
    return cells.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(cells: DataFrame, out: str = "distinct_estimate") -> DataFrame:
    """Cells with the estimate in place of the sketch."""
    return cells.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")
