"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from prefixes.  Level one is every word of a language, level two every pair of
words that are frequent enough.  The count of a prefix bounds all that grows from it: cutting a phrase after
its first word gives ``l = f(first)`` and ``r >= a``, so its score is at most ``f(prefix) / f(first word)``.
Pairs are therefore a frontier in the order of that bound, and three-word phrases are counted only for the
part of the frontier that can still matter:

* a round takes a score for each language, that of the ``2 * top``-th best phrase as far as is known, and
  expands every pair whose bound reaches it;
* it also counts every longer phrase that holds a pair of at least that score, on either side, as such a
  phrase may drop the pair;
* now every phrase of at least that score is known with its count and its fate.  A language with ``top``
  survivors among them is settled, ties included; for the others the next round goes twice as deep, down to
  score zero.

Counting is a scan of the texts.  Tasks number the words of a block, count by sorting packed numbers and send
pairs and triples as 64-bit word digests; words meet as text once, in level one, where two words with one
digest would show (the digests are then made with another seed).  Which positions a scan counts is told by
filters of fixed size (``bitfilter``); what they let through besides is counted in full, so never wrong.

Defined results: a null text is empty and a null language ``und``; a text, piece or language without words
adds nothing; repeated rows count again; an empty table gives no row; only ``text`` and ``lang`` are read,
whatever else the table holds; texts of any length are read whole, a block is closed after the text that
fills it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insight.llm import bitfilter
from insight.llm.storage import stored

#: Words that a task counts at once; rows that it takes from a batch, and that it sends, at once.
BLOCK_WORDS, ROWS_IN, ROWS_OUT = 1_500_000, 256, 100_000
#: Digest seeds that are tried before giving up; at 64 bits a second try is already rare.
SEEDS = 8

_BOUNDARY = b"\xff"  # no byte of UTF-8
_FOLD = bytes(_BOUNDARY[0] if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b
              for b in range(256))


class _Block:
    """Words of some texts as numbers; number 0 stands between pieces."""

    def __init__(self):
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.runs: list[np.ndarray] = []
        self.size = 0
        self.by_lang: dict[str, dict[bytes, int]] = {}

    def add(self, lang: str, text: str) -> None:
        known = self.by_lang.setdefault(lang, {_BOUNDARY: 0})
        words = text.encode().translate(_FOLD).replace(_BOUNDARY, b" \xff ").split()
        for w in set(words).difference(known):
            self.langs.append(lang)
            self.words.append(w)
            known[w] = len(self.words)
        self.runs.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words) + 1

    def stream(self) -> np.ndarray:
        """All numbers with a 0 between texts; the block takes no more texts afterwards."""
        self.by_lang.clear()
        out = np.zeros(self.size + 1, dtype=np.int32)
        at = 0
        for run in self.runs:
            out[at:at + len(run)] = run
            at += len(run) + 1
        self.runs.clear()
        return out

    def digests(self, seed: int) -> np.ndarray:
        """By number; the language is part of what is hashed."""
        return np.array([0, *[_digest(g, w, seed) for g, w in zip(self.langs, self.words)]], dtype=np.uint64).view(np.int64)


def _digest(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\xff" + word, seed)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_IN):
            rows = batch.slice(at, ROWS_IN)
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                block.add(lang, text)
                if block.size >= BLOCK_WORDS:
                    yield block
                    block = _Block()
    if block.size:
        yield block


def _read(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text")).where("text <> ''")


def _word_counts(df: DataFrame, seed: int) -> DataFrame:
    """``lang``, ``word``, its digest ``h`` and its count ``f``, for every word."""

    def run(batches):
        for block in _blocks(batches):
            counts = np.bincount(block.stream(), minlength=len(block.words) + 1)[1:]
            digests = block.digests(seed)[1:]
            for at in range(0, len(block.words), ROWS_OUT):
                to = at + ROWS_OUT
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.langs[at:to]), pa.array(block.words[at:to], pa.binary()).cast(pa.string()),
                     pa.array(digests[at:to]), pa.array(counts[at:to])], names=["lang", "word", "h", "f"])

    part = _read(df).mapInArrow(run, "lang string, word string, h long, f long")
    return part.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def _grams(df: DataFrame, width: int, seed: int, wanted) -> DataFrame:
    """Counts ``a`` of the runs of ``width`` words (digests ``h1``, ``h2``, ...) for which ``wanted`` says yes.

    ``wanted`` gets the digests of the block's positions, one array per place, and must decide by them alone:
    then a phrase is counted either everywhere or nowhere.
    """
    names = [f"h{k + 1}" for k in range(width)]

    def run(batches):
        for block in _blocks(batches):
            stream, digests = block.stream(), block.digests(seed)
            n = len(stream) - width + 1
            if n < 1:
                continue
            inside = np.logical_and.reduce([stream[k:n + k] > 0 for k in range(width)])
            places = [stream[k:n + k][inside] for k in range(width)]
            keep = wanted(*[digests[p] for p in places])
            places = [p[keep].astype(np.int64) for p in places]
            bits = max(1, int(len(digests) - 1).bit_length())
            if width == 3 and 3 * bits > 63:  # too many words for one packed number: pairs get numbers first
                pairs, places[1] = np.unique(places[0] << bits | places[1], return_inverse=True)
                keys, counts = np.unique(places[1].astype(np.int64) << bits | places[2], return_counts=True)
                found = pairs[keys >> bits]
                parts = [found >> bits, found & (1 << bits) - 1, keys & (1 << bits) - 1]
            else:
                packed = places[0]
                for p in places[1:]:
                    packed = packed << bits | p
                del places, inside, keep
                keys, counts = np.unique(packed, return_counts=True)
                parts = [keys >> bits * (width - 1 - k) & (1 << bits) - 1 for k in range(width)]
            for at in range(0, len(keys), ROWS_OUT):
                to = at + ROWS_OUT
                yield pa.RecordBatch.from_arrays([*[pa.array(digests[p[at:to]]) for p in parts], pa.array(counts[at:to].astype(np.int64))], names=[*names, "a"])

    part = _read(df).mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", a long")
    return part.groupBy(*names).agg(F.sum("a").alias("a"))


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)) with exact decimals (counts below 10^13)."""
    d = "decimal(13,0)"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as {d}) * cast({a} as {d})) div (cast({left} as {d}) * cast({right} as {d}))")


def _unique_digests(df: DataFrame) -> tuple[DataFrame, int]:
    for seed in range(SEEDS):
        words = stored(_word_counts(df, seed), "collocations-words")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            return words, seed
    raise ValueError("no seed gives every word a digest of its own")


def _pairs(df: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """Level two: pairs with their counts, score ``s`` and the bound ``u`` of what grows from them."""
    frequent = words.where(F.col("f") >= least)
    members = df.sparkSession.sparkContext.broadcast(bitfilter.build(frequent, "h"))
    counted = _grams(df, 2, seed, lambda a, b: bitfilter.holds(members.value, a) & bitfilter.holds(members.value, b))
    first = frequent.select("lang", F.col("h").alias("h1"), F.col("f").alias("f1"))
    second = frequent.select(F.col("h").alias("h2"), F.col("f").alias("f2"))
    return stored(counted.where(F.col("a") >= least).join(first, "h1").join(second, "h2")
                  .withColumn("s", _score("a", "f1", "f2"))
                  .withColumn("u", F.expr("(cast(1000000 as decimal(20,0)) * a) div cast(f1 as decimal(20,0))")), "collocations-pairs")


def _triples(df: DataFrame, pairs: DataFrame, depth: DataFrame, filters: list, seed: int, least: int) -> tuple[DataFrame, tuple]:
    """Three-word phrases that this round's depth (``lang``, ``t``) asks for and no earlier round has counted."""
    deep = pairs.join(F.broadcast(depth), "lang")  # one row per language that is not settled; size bound: languages
    grow, settle = (df.sparkSession.sparkContext.broadcast(bitfilter.build(deep.where(F.col(c) >= F.col("t")), "h1", "h2")) for c in ("u", "s"))

    def wanted(a, b, c):
        asked = lambda grow, settle: bitfilter.holds(grow.value, a, b) | bitfilter.holds(settle.value, b, c)
        out = asked(grow, settle)
        for earlier in filters:
            out &= ~asked(*earlier)
        return out

    counted = _grams(df, 3, seed, wanted).where(F.col("a") >= least)
    first = pairs.select("h1", "h2", "lang", "f1", F.col("a").alias("p12"))
    rest = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f2").alias("f3"), F.col("a").alias("p23"))
    scored = (counted.join(first, ["h1", "h2"]).join(rest, ["h2", "h3"])
              .withColumn("s1", _score("a", "f1", "p23")).withColumn("s2", _score("a", "p12", "f3")))
    return stored(scored, "collocations-triples"), (grow, settle)


def _alive(pairs: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer phrase known so far drops, with the cut that scores lowest."""
    longest = (triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
               .groupBy("h1", "h2").agg(F.max("a").alias("longer")))
    none = F.lit(None).cast("long")
    two = (pairs.join(longest, ["h1", "h2"], "left").where(f"longer is null or 100 * longer < {share} * a")
           .select("lang", "h1", "h2", none.alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "s"))
    low = F.col("s1") <= F.col("s2")
    three = triples.select("lang", "h1", "h2", "h3", "a", F.when(low, F.col("f1")).otherwise(F.col("p12")).alias("l"),
                           F.when(low, F.col("p23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("s"))
    return two.unionByName(three)


def collocations(df: DataFrame, top: int = 2000, least: int = 10, share: int = 50) -> DataFrame:
    """The ``top`` best phrases of two or three words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``least``: lowest count of a candidate.  ``share``: a candidate goes if a longer one that holds it has at
    least that percentage of its count.
    """
    spark = df.sparkSession
    words, seed = _unique_digests(df)
    pairs = _pairs(df, words, seed, least)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    open_langs = [r.lang for r in pairs.select("lang").distinct().collect()]  # as many rows as languages
    triples, filters, deep, reach = None, [], {}, 2 * top
    best = Window.partitionBy("lang").orderBy(F.desc("s"))
    while open_langs:
        known = _alive(pairs, triples, share) if triples is not None else pairs
        known = known.where(F.col("lang").isin(open_langs))
        nth = known.select("lang", "s", F.row_number().over(best).alias("k")).where(F.col("k") <= reach)
        rows = nth.groupBy("lang").agg(F.max("k").alias("k"), F.min("s").alias("s")).collect()
        now = {r.lang: r.s if r.k == reach else 0 for r in rows}
        depth = spark.createDataFrame([(g, min(now.get(g, 0), deep.get(g, 1 << 62))) for g in open_langs], "lang string, t long")
        more, own = _triples(df, pairs, depth, filters, seed, least)
        triples = more if triples is None else triples.unionByName(more)
        filters.append(own)
        deep |= {r.lang: r.t for r in depth.collect()}
        settled = _alive(pairs, triples, share).join(F.broadcast(depth), "lang").where("s >= t").groupBy("lang").count()
        enough = {r.lang for r in settled.where(F.col("count") >= top).collect()}
        open_langs = [g for g in open_langs if g not in enough and deep[g] > 0]
        reach *= 2
    if triples is None:
        triples = spark.createDataFrame([], "h2 long, h3 long, h1 long, a long, lang string, f1 long, p12 long, f3 long, p23 long, s1 long, s2 long")
    depths = spark.createDataFrame(list(deep.items()), "lang string, t long")
    final = _alive(pairs, triples, share).join(F.broadcast(depths), "lang").where("s >= t")
    # with ties at the last place, whose order only the text decides
    final = final.withColumn("_k", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("s"), F.desc("a")))).where(F.col("_k") <= top)
    for k in (1, 2, 3):
        final = final.join(words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
    final = final.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("s"), F.desc("a"), "phrase"))
    return (final.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).join(F.broadcast(sizes), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("s").alias("score")))
