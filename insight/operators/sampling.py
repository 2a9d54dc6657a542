"""Deterministic splits and bootstrap up-sampling.

Draws are keyed by ``md5(id || ':' || seed)``, so results do not depend on
partitioning or task order (``randomSplit`` and ``sample`` do).  Sizes follow
scikit-learn: the test side holds ``ceil(test_size * n)`` rows (per stratum
when stratified).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.operators.joins import broadcast_if_small
from insight.operators.ranking import rank_rows, split_point_flags


def hash_key(id_col: str, seed: int) -> Column:
    """Per-row draw key: md5 of ``id:seed`` (hex string)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_int(text: Column) -> Column:
    """First 60 bits of an md5 hex digest as a non-negative integer."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42,
          stratify: str | None = None, out: str = "is_test") -> DataFrame:
    """Flag ``ceil(test_size * n)`` rows as test (D1), per label with ``stratify``.

    The rows with the smallest draw keys form the test side; only the
    boundary key per stratum is computed (range-partitioned rank of the
    narrow key), then every row is compared with it.
    """
    keyed = df.withColumn("_key", hash_key(id_col, seed))
    by = [stratify] if stratify else []
    # the first 13 hex digits (52 bits, exact in a double) order like the key
    lead = F.conv(F.substring("_key", 1, 13), 16, 10).cast("double")
    flagged = split_point_flags(keyed, [("_key", True), (id_col, True)], test_size, out=out, by=by,
                                lead=lead)
    return flagged.drop("_key")


def class_sizes(df: DataFrame, label: str) -> list[tuple[object, int]]:
    """Class sizes, smallest first (ties: smaller label); one row per class."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r[0], int(r[1])) for r in rows), key=lambda t: (t[1], t[0]))


def oversample(df: DataFrame, label: str, id_col: str, seed: int = 42,
               copy_col: str = "copy_id") -> DataFrame:
    """Bootstrap the minority class up to the majority size.

    Output: majority rows (``copy_id`` 0) plus exactly ``n_majority`` drawn
    minority rows (``copy_id`` = draw number i).  Draw i takes the minority
    row of rank ``1 + hash(i:seed) % m`` (ranked by id).  The draws are
    ``spark.range`` rows (distributed); the minority side is joined by shuffle
    or, when it is proven small, by broadcast.  Two classes are expected;
    the class sizes (one number per class) are the only values collected.
    """
    sizes = class_sizes(df, label)
    if len(sizes) < 2:
        return df.withColumn(copy_col, F.lit(0).cast("long"))
    (mino, m), (_, n_maj) = sizes[0], sizes[-1]
    majority = df.where(F.col(label) != F.lit(mino)).withColumn(copy_col, F.lit(0).cast("long"))
    minority = df.where(F.col(label) == F.lit(mino))
    ranked = broadcast_if_small(rank_rows(minority, [(id_col, True)], rank_col="_r").drop("_n"))
    draws = df.sparkSession.range(1, n_maj + 1).select(
        F.col("id").alias(copy_col),
        (F.lit(1) + F.pmod(hash_int(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))),
                           F.lit(m))).alias("_r"))
    drawn = draws.join(ranked, on="_r", how="inner").drop("_r")
    return majority.unionByName(drawn.select(*df.columns, copy_col))


def balanced_weight_table(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``(label, n / (classes * n_class))``: one row per class (M7)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.select(F.struct(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select(label, (totals["n"].cast("double") / (totals["k"] * F.col("_nc"))).alias(out))


def balanced_weights(df: DataFrame, label: str, out: str = "weight", fit_on: DataFrame | None = None) -> DataFrame:
    """``class_weight='balanced'`` per row (M7), counted on ``fit_on`` (default ``df``).

    The class table has one row per class and is joined back behind a size
    check.
    """
    w = balanced_weight_table(fit_on if fit_on is not None else df, label, out)
    return df.join(broadcast_if_small(w), on=label, how="left")
