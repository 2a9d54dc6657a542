"""SimHash near-duplicates through an index over byte positions.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that differ in at most two bits share
at least six of them at the same place, hence at least two of the four neighbouring byte pairs.  The index
posts every distinct fingerprint under each of the six ways to take two byte pairs; documents that share a
posting are candidates.  Per candidate pair, from whichever list, the shared positional bytes are tallied,
pairs below the guaranteed minimum are dropped, and the bit distance verifies the rest.

Exact copies share one fingerprint and never meet as pairs.  A posting list longer than ``PAIR_LIST`` is
split before it is paired: its members (equal in four bytes) are posted again under their one-bit neighbours
in the other four bytes, and two of them differ in at most two bits exactly if they share such a posting.
A split list holds at most 33 fingerprints and pairs each with its smallest, so no list, however hot, produces
pairs by the square of its length and no link is lost.

Defined results: a text without words (null, empty or blank) has fingerprint zero and is linked like any
other; repeated rows each get a row; a null id gets the component of its fingerprint, and a component whose
ids are all null has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.llm.columns import boxed, unboxed
from insight.llm.storage import stored

#: Longest posting list that is joined with itself; longer ones are split first.  It chooses the plan, not the result.
PAIR_LIST = 32
#: Shingles hashed at once, which bounds a task's memory on very long texts.
BLOCK = 1 << 16


def fingerprint(raw: bytes, shingle: int, seed: int) -> int:
    """SimHash of one text: a bit is set if it is set in over half of the shingles' hashes."""
    words = raw.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    width = min(shingle, len(words))
    spans = list(zip(starts, ends[width - 1:]))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e - 1], seed) for s, e in spans[at:at + BLOCK]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int, seed: int = 42, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a (signed) long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t.encode(), shingle, seed) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, F.pandas_udf(run, T.LongType())(F.col(text)))


def _mask(groups: tuple[int, ...]) -> int:
    """Bits of the given neighbouring byte pairs, as a signed long."""
    m = sum(0xFFFF << 16 * g for g in groups)
    return m - (1 << 64) if m >> 63 else m


MASKS = [_mask(c) for c in combinations(range(4), 2)]


def _one_bit(bit: int) -> int:
    return -(1 << 63) if bit == 63 else 1 << bit


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) that connect all within ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees its matches up to two bits")
    postings = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("g", "key"))
    lists = postings.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(postings.join(lists, ["g", "key"]), "simhash-postings")

    short = members.where(F.col("n") <= PAIR_LIST)
    a, b = short.select("g", "key", F.col("fp").alias("a")), short.select("g", "key", F.col("fp").alias("b"))
    paired = a.join(b, ["g", "key"]).where(F.col("a") < F.col("b")).select("a", "b")
    if max_bits < 2:  # a common neighbour may mean two bits; lists under an exact mask are paired as they are
        wide = members.where(F.col("n") > PAIR_LIST)
        flips = [0, *[_one_bit(i) for i in range(64)]] if max_bits == 1 else [0]
        near = wide.select(F.col("fp").alias("a"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("b"))
        hubs = near.join(nodes.select(F.col("fp").alias("b")), "b").where("a < b").select("a", "b")
    else:
        wide = members.where(F.col("n") > PAIR_LIST)
        near = wide.select("g", "key", "fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_one_bit(i)) for i in range(64)])).alias("flip"))
        near = near.where(F.col("flip").bitwiseAND(F.element_at(F.array(*map(F.lit, MASKS)), F.col("g") + 1)) == 0)
        balls = (near.groupBy("g", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
                 .agg(F.collect_set("fp").alias("ball")).where(F.size("ball") > 1))
        hubs = (balls.select(F.array_min("ball").alias("a"), F.explode("ball").alias("b")).where("a <> b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))
    counted = paired.unionByName(hubs).where(shared >= 8 - max_bits)
    return counted.where(F.bit_count(differ) <= max_bits).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``fp`` -> ``root`` (its component's smallest fingerprint) for every end of ``edges`` (``a``, ``b``).

    Alternating large and small stars: every node points its neighbours to the smallest it knows, which
    halves distances and ends, after about the logarithm of the longest chain, with one star per component.
    Every round is written to the shared folder; minima are pre-aggregated, so a hot node costs no long task.
    """
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "simhash-edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "simhash-edges")
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, shingle: int, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest linked id)."""
    marked = stored(fingerprints(df.select(id_col, text), shingle, seed, text).select(id_col, "fp"), "simhash-fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "simhash-nodes")
    roots = connected(links(nodes, max_bits))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lows, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, shingle: int, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns) with one left of each component: that of the smallest id.

    A null id counts as the largest; of rows with the same id and of fully equal rows one is left as well.  Rows are
    told apart by id and 128 bits of all columns, whose names may be any.
    """
    own = [f"in{k}_" for k in range(len(df.columns))]
    rows = boxed(df, i=id_col, body=text)
    rows = rows.select(*own, "body", F.struct(F.col("i").isNull().alias("n"), "i", F.xxhash64(*own).alias("k"), F.xxhash64(F.lit("check"), *own).alias("c")).alias("id"))
    classes = near_duplicates(rows.select("id", F.col("body").alias("text")), shingle, max_bits, seed, "id", "text")
    first = classes.where("id = component_id").select("id").distinct()
    left = rows.drop("body").join(first, "id", "left_semi")
    one = left.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.lit(1)))).where("at = 1")
    return unboxed(one, df.columns)
