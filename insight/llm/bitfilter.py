"""Fixed-size membership filters: a bit per hash bucket, ORed in Spark and sent to tasks.

A filter never misses a member; others pass it now and then, so whatever it lets through is either counted
in full all the same or joined exactly afterwards.  Its size is ``2 ** FILTER_BITS`` bits whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^26 bits are 8 MB in the driver and in each Python worker.
FILTER_BITS = 26


def mix(*keys: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit value per row of several signed longs; ``mixed`` is the same in SQL."""
    out = np.zeros(len(keys[0]), dtype=np.uint64)
    for k in keys:
        out = out * np.uint64(31) + k.astype(np.int64).view(np.uint64)
    return out


def mixed(*columns: str):
    """The low ``FILTER_BITS`` bits of ``mix`` of long columns (products are cut to those bits, so none overflows)."""
    low = F.lit((1 << FILTER_BITS) - 1).cast("long")
    out = F.lit(0).cast("long")
    for c in columns:
        out = (out * 31 + F.col(c).bitwiseAND(low)).bitwiseAND(low)
    return out


def build(df: DataFrame, *columns: str) -> np.ndarray:
    """The filter of the rows of ``df``; at most ``2 ** (FILTER_BITS - 6)`` words of 64 bits come to the driver."""
    bucket = mixed(*columns)
    words = (df.select(F.shiftright(bucket, 6).cast("int").alias("at"), bucket.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("bit"))
             .groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toPandas())
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    out[words["at"].to_numpy(dtype=np.int64)] = words["word"].to_numpy(dtype=np.int64)
    return out


def holds(words: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether each row (given as signed longs) may be a member."""
    at = (mix(*keys) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (words[at >> 6] >> (at & 63)) & 1 == 1
