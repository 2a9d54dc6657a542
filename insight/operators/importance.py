"""Permutation importance (M17): how many predictions go wrong when one feature's values are dealt anew.

Rows are put into an order by a hash of their key; for feature ``j`` every row takes the value of the row a fixed
number of places on, a permutation of the column that has nothing to do with the rows.  One ranking and one shuffle
serve all features: a row sends its values to the places that take them, and places are aggregated by number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.operators.ranking import rank_rows
from insight.session import materialize


def places_on(n: Column, j: int, m: int) -> Column:
    """How many places on feature ``j`` of ``m`` is read, of ``n`` rows: spread over the table, one at least."""
    return F.floor(n * F.lit(2 * j + 1) / F.lit(2 * m)).cast("long") + 1


def with_permuted(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int) -> DataFrame:
    """``key``, ``label``, the features as doubles and their permuted values ``permuted_<feature>``."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    narrow = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features], h.alias("_h"))
    ranked = rank_rows(narrow, [("_h", True), (key, True)], rank_col="_rank", total_col="_n")
    place = F.col("_rank") - 1
    m = len(features)
    sent = [F.struct(place.alias("place"), F.lit(-1).alias("j"), F.lit(None).cast("double").alias("v"))]
    # the row at a place takes its value from the row ``places_on`` further: that row sends it back as many
    sent += [F.struct(F.pmod(place - places_on(F.col("_n"), j, m), F.col("_n")).alias("place"), F.lit(j).alias("j"), F.col(c).alias("v"))
             for j, c in enumerate(features)]
    rows = ranked.select(key, label, *features, F.explode(F.array(*sent)).alias("s"))
    own = F.col("s.j") == -1
    return rows.groupBy("s.place").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in (key, label, *features)],
        *[F.max(F.when(F.col("s.j") == j, F.col("s.v"))).alias(f"permuted_{c}") for j, c in enumerate(features)]).drop("place")


def permutation_importance(df: DataFrame, probability: Callable[[], Column], features: Sequence[str], label: str, key: str,
                           seed: int) -> DataFrame:
    """``feature``, ``hits`` (right predictions of ``probability() > 0.5``), ``hits_permuted`` and ``importance`` (their
    difference as a share of the rows), one row per feature.  ``probability`` reads the features by name."""
    both = materialize(with_permuted(df, features, label, key, seed))

    def right(p: str) -> Column:
        return F.count_if((F.col(p) > 0.5) == (F.col(label) == 1))

    def hits(feature: str) -> DataFrame:
        plain = both.withColumn("_plain", probability())
        swapped = plain.withColumn(feature, F.col(f"permuted_{feature}")).withColumn("_swapped", probability())
        return swapped.agg(F.lit(feature).alias("feature"), right("_plain").alias("hits"), right("_swapped").alias("hits_permuted"),
                           F.count(F.lit(1)).alias("_rows"))

    frames = reduce(DataFrame.unionByName, [hits(c) for c in features])
    return frames.select("feature", "hits", "hits_permuted", ((F.col("hits") - F.col("hits_permuted")) / F.col("_rows")).alias("importance"))
