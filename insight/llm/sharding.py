"""Proportional stratified interleaving of rows into shards.

Rows of every source are put in a seeded random order and numbered; row ``r`` of ``n`` has the fractional
rank ``(2r - 1) / 2n``.  Sorted by that, the sources lie evenly mixed, and cutting the order into equal runs
gives shards whose row counts differ by one at most and which match the mixture to within one row per source.

Neither of the two orders is made in one task, however large a source is: the seeded hash (and then the
fractional rank) is uniform, so its leading part cuts the rows into even buckets, as many as the square root
of the number of rows: a bucket that is sorted and the list of bucket offsets both grow with that root only.
Counts per bucket give each bucket's offset.  A row's bucket is a function of the row and the number of
buckets, so every recomputation agrees.

Defined results: a null source is a source of its own; rows with a null id take part; repeated rows get
places next to each other; an empty table gives no rows; other columns pass through whatever their names, and
columns called ``shard`` or ``slot`` are replaced.  Equal ids spread by the hash of all their columns.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight.llm.columns import boxed, unboxed
from insight.llm.storage import stage_folder


def _numbered(df: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """``df`` with the 1-based place of each row in ``group`` by (bucket, order) and the group's size."""
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*group)).alias(total))
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    placed = rows.withColumn(rank, F.row_number().over(within)).join(offsets, [*group, "_b"])
    return placed.withColumn(rank, F.col(rank) + F.col("_off")).drop("_b", "_off")


def interleave(df: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", source: str = "source",
               buckets: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, from 0).

    Counts the rows first (from the file footers where ``df`` is a table) unless ``buckets`` is given, the
    number of buckets that each order is cut into; up to 2^24 of them fill evenly.
    """
    if buckets is None:
        buckets = max(1, isqrt(df.count()))
    rows = boxed(df, _id=id_col, _src=source)
    rows = rows.withColumn("_s", F.concat(F.when(F.col("_src").isNull(), F.lit("n")).otherwise(F.lit("s")),
                                          F.coalesce(F.col("_src").cast("string"), F.lit(""))))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id"))).withColumn("_e", F.xxhash64(*[F.col(f"in{k}_") for k in range(len(df.columns))]))
    ranked = _numbered(rows, ["_s"], F.pmod(F.shiftright(F.xxhash64("_h", "_e"), 40), F.lit(buckets)).cast("int"), ["_h", "_id", "_e"], "_r", "_n")
    ranked = ranked.withColumn("_f", (2 * F.col("_r") - 1).cast("double") / (2 * F.col("_n")).cast("double")).drop("_n", "_r")
    cell = F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int")
    placed = _numbered(ranked.withColumn("_all", F.lit(0)), ["_all"], cell, ["_f", "_s", "_h", "_id", "_e"], "_p", "_n")
    at = F.col("_p") - 1
    shard = F.expr(f"(_p - 1) * {shards} div _n")
    first = F.expr(f"(shard * _n + {shards - 1}) div {shards}")
    return unboxed(placed.withColumn("shard", shard.cast("int")).withColumn("slot", (at - first).cast("long")), df.columns, "shard", "slot")


def write_shards(df: DataFrame, shards: int, path: str | None = None, **how) -> str:
    """Write the rows as one folder per shard, in order of their slots; returns the path (in the shared folder)."""
    path = path or stage_folder(df.sparkSession, "shards")
    placed = interleave(df, shards, **how)
    placed.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard and slot of every document; counts per shard differ by one at most (law ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
