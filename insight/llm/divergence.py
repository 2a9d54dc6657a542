"""Divergence of the sources of each language, with strings materialised late.

Terms meet in shuffles only as fixed-width digests.  A scan counts each block of texts in its task and stores
two tables, unshuffled: digest counts per (language, source), and the block's dictionary, the smallest and
largest string of each digest.  Counts are shuffled and summed by digest and those of rare terms go.  Only
then does the dictionary join in, for kept digests alone: a digest whose smallest and largest string differ
stands for several terms, and is split by counting its terms again by their text.  After that, digests are
exact names of terms; sums over pairs of sources run on numbers, and texts come back for the few terms that
the result names.

Defined results: null text, language or source read as empty; a group without terms is still a group; with no
kept term pairs have value 0 and no term rows follow; repeated rows count as documents of their own; an empty
table gives no row; only ``text``, ``lang`` and ``source`` are read, whatever else the table holds; texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insight.llm import bitfilter
from insight.llm.storage import stage_folder, stored

#: Words that a task counts at once; rows that it takes from a batch, and that it sends, at once.
BLOCK_WORDS, ROWS_IN, ROWS_OUT = 3_000_000, 256, 100_000
#: Numbers (terms x sources) of one block of the pair sums.
BLOCK_CELLS = 1 << 17
SEED = 7
SCALE = 1_000_000_000

_FOLD = bytes(0x20 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))


def _digest(term: bytes, bits: int) -> int:
    h = xxhash.xxh64_intdigest(term, SEED) & (1 << bits) - 1
    return h - (1 << 64) if h >> 63 else h


class _Block:
    """Terms of some documents as numbers."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.group_of: list[int] = []
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, source: str, text: str) -> None:
        words = text.encode().translate(_FOLD).split()
        number = self.terms
        for w in set(words).difference(number):
            number[w] = len(number)
        self.group_of.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.runs.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words) + 1

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group, term number, occurrences and documents, by group and term."""
        doc = np.repeat(np.arange(len(self.runs)), [len(r) for r in self.runs])
        per_doc, n = np.unique(doc << 32 | np.concatenate(self.runs), return_counts=True)
        key = np.array(self.group_of, dtype=np.int64)[per_doc >> 32] << 32 | per_doc & 0xFFFFFFFF
        order = np.argsort(key, kind="stable")
        key, starts, docs = np.unique(key[order], return_index=True, return_counts=True)
        n = np.add.reduceat(n[order], starts) if len(starts) else n
        return key >> 32, key & 0xFFFFFFFF, n, docs


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_IN):
            rows = batch.slice(at, ROWS_IN)
            for row in zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "text"))):
                block.add(*row)
                if block.size >= BLOCK_WORDS:
                    yield block
                    block = _Block()
    if block.terms:
        yield block


def _read(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _scan(df: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Stored: ``lang, source, digest, n, docs`` by block, and ``digest, low, high`` by block."""

    def run(batches):
        for block in _blocks(batches):
            if not block.terms:
                continue
            terms, groups = list(block.terms), list(block.groups)
            digests = np.array([_digest(t, bits) for t in terms], dtype=np.int64)
            group, term, n, docs = block.counts()
            for at in range(0, len(group), ROWS_OUT):
                own, to = group[at:at + ROWS_OUT].tolist(), at + ROWS_OUT
                none = pa.nulls(len(own), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["counts"] * len(own)), pa.array([groups[g][0] for g in own]), pa.array([groups[g][1] for g in own]), pa.array(digests[term[at:to]]),
                     pa.array(n[at:to].astype(np.int64)), pa.array(docs[at:to].astype(np.int64)), none, none], names=names)
            low, high = {}, {}
            for d, t in zip(digests.tolist(), terms):
                low[d], high[d] = min(low.get(d, t), t), max(high.get(d, t), t)
            none, zero = pa.nulls(len(low), pa.string()), pa.nulls(len(low), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(["terms"] * len(low)), none, none, pa.array(list(low), pa.int64()), zero, zero,
                                              _strings(list(low.values())), _strings([high[d] for d in low])], names=names)

    names = ["kind", "lang", "source", "digest", "n", "docs", "low", "high"]
    kinds = "kind string, lang string, source string, digest long, n long, docs long, low string, high string"
    path = stage_folder(df.sparkSession, "divergence-scan")
    _read(df).where("text <> ''").mapInArrow(run, kinds).write.partitionBy("kind").parquet(path)
    both = df.sparkSession.read.schema(kinds).option("basePath", path).parquet(path)
    return (both.where("kind = 'counts'").select("lang", "source", "digest", "n", "docs"),
            both.where("kind = 'terms'").select("digest", "low", "high"))


def _kept(cells: DataFrame, least_docs: int, *term: str) -> DataFrame:
    """``lang, source, *term, n`` of terms in at least ``least_docs`` documents of the language; one shuffle."""
    docs = F.sum("docs").over(Window.partitionBy("lang", *term))
    return (cells.repartition("lang", *term).groupBy("lang", *term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("_all", docs).where(F.col("_all") >= least_docs).select("lang", "source", *term, "n"))


def _split(df: DataFrame, collided: DataFrame, bits: int, least_docs: int) -> DataFrame:
    """``lang, source, digest, term, n`` of the kept terms behind the collided digests, counted by text."""
    members = df.sparkSession.sparkContext.broadcast(bitfilter.build(collided, "digest"))

    def run(batches):
        for block in _blocks(batches):
            terms, groups = list(block.terms), list(block.groups)
            if not terms:
                continue
            digests = np.array([_digest(t, bits) for t in terms], dtype=np.int64)
            group, term, n, docs = block.counts()
            hit = bitfilter.holds(members.value, digests)[term]
            group, term, n, docs = group[hit], term[hit], n[hit], docs[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[g][0] for g in group.tolist()], pa.string()), pa.array([groups[g][1] for g in group.tolist()], pa.string()),
                 pa.array(digests[term]), _strings([terms[t] for t in term.tolist()]), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
                names=["lang", "source", "digest", "term", "n", "docs"])

    found = _read(df).where("text <> ''").mapInArrow(run, "lang string, source string, digest long, term string, n long, docs long")
    return _kept(found.join(collided, "digest", "left_semi"), least_docs, "digest", "term")


def kept_terms(df: DataFrame, least_docs: int = 10, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``lang, source, digest, sub, n`` of kept terms, and ``digest, sub, term``: their texts.

    ``sub`` is 0 but for terms that share a digest.  ``bits``: width of the digests (narrow ones for tests).
    """
    counts, dictionary = _scan(df, bits)
    cells = stored(_kept(counts, least_docs, "digest"), "divergence-kept")
    texts = stored(dictionary.join(cells.select("digest").distinct(), "digest", "left_semi")
                   .groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")), "divergence-texts")
    collided = texts.where("low <> high").select("digest")
    one = texts.where("low = high").select("digest", F.lit(0).alias("sub"), F.col("low").alias("term"))
    cells_of_one = cells.select("lang", "source", "digest", F.lit(0).alias("sub"), "n")
    if collided.isEmpty():
        return cells_of_one, one
    own = stored(_split(df, collided, bits, least_docs), "divergence-split")
    subs = stored(own.select("digest", "term").distinct()
                  .withColumn("sub", F.dense_rank().over(Window.partitionBy("digest").orderBy("term"))), "divergence-subs")
    cells = cells_of_one.join(collided, "digest", "left_anti").unionByName(
        own.join(subs, ["digest", "term"]).select("lang", "source", "digest", "sub", "n"))
    return cells, one.unionByName(subs.select("digest", "sub", "term"))


def _p(count: str, total: str, kept: str):
    """1 + floor(10^9 (count + 2) / (N + 2 V)), exactly."""
    d = "decimal(19,0)"
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * (cast({count} as {d}) + 2)) div (cast({total} as {d}) + 2 * cast({kept} as {d}))")


def _f(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, value``: sums of f over all kept terms of the language, for sources g < h (numbers).

    Terms are dealt by digest into blocks of at most about ``BLOCK_CELLS`` numbers; a block is a table of
    terms by sources, filled with what a source gives a term that it lacks, and adds one number per pair.
    """
    blocks = groups.groupBy("lang").agg(F.max(F.expr(f"cast(ceil(v * s / {BLOCK_CELLS}) as int)")).alias("blocks"))
    base = groups.join(blocks, "lang").where("blocks > 0").select(F.col("lang").alias("base_lang"), F.col("g").alias("k"), F.col("p0").alias("base"),
                                                                  F.explode(F.expr("sequence(0, blocks - 1)")).alias("base_block"))
    dealt = (cells.join(blocks, "lang").withColumn("block", F.expr("cast(pmod(xxhash64(digest, sub), blocks) as int)"))
             .select("lang", "block", "digest", "sub", "g", "p"))

    def run(part: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        columns = ["lang", "g", "h", "value"]
        if part.empty or len(sources) < 2:
            return pd.DataFrame(columns=columns)
        sources = sources.sort_values("k")
        g, p0 = sources["k"].to_numpy(np.int64), sources["base"].to_numpy(np.int64)
        term = pd.MultiIndex.from_frame(part[["digest", "sub"]]).factorize()[0]
        table = np.repeat(p0[:, None], term.max() + 1, axis=1)
        table[np.searchsorted(g, part["g"].to_numpy(np.int64)), term] = part["p"].to_numpy(np.int64)
        out = []
        for k in range(len(g) - 1):
            less = table[k + 1:] - table[k]
            out.append(pd.DataFrame({"g": g[k], "h": g[k + 1:], "value": (less * less // (table[k + 1:] + table[k])).sum(axis=1)}))
        return pd.concat(out).assign(lang=part["lang"].iloc[0])[columns]

    sums = dealt.groupBy("lang", "block").cogroup(base.groupBy("base_lang", "base_block")).applyInPandas(
        run, "lang string, g long, h long, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, least_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source and the ``top`` most typical terms of each source."""
    cells, texts = kept_terms(df, least_docs, bits)
    cells = stored(cells, "divergence-cells")
    names = stored(_read(df).select("lang", "source").distinct(), "divergence-groups")
    in_lang = Window.partitionBy("lang")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = cells.groupBy("lang", "digest", "sub").agg(F.sum("n").alias("in_lang"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    groups = (names.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v", "lang_total"])
              .withColumn("s", F.count(F.lit(1)).over(in_lang))
              .withColumn("g", F.row_number().over(in_lang.orderBy("source")).cast("long"))
              .withColumn("p0", F.when(F.col("v") > 0, _p("0", "total", "v"))))
    groups = stored(groups, "divergence-sizes")
    known = cells.join(groups, ["lang", "source"]).withColumn("p", _p("n", "total", "v"))

    sums = _pair_sums(known.select("lang", "digest", "sub", "g", "p"), groups.where("v > 0").select("lang", "g", "p0", "v", "s"))
    both = sums.unionByName(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    mine = groups.select("lang", "source", "g")
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = (mine.join(other, "lang").where("g <> h").join(both, ["lang", "g", "h"], "left")
            .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
            .withColumn("rank", F.row_number().over(by_value)))

    typical = (known.join(kept, ["lang", "digest", "sub"]).withColumn("q", _p("in_lang", "lang_total", "v")).where("p > q")
               .withColumn("value", _f("p", "q"))
               .withColumn("_k", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_k") <= top))
    term = (typical.join(texts, ["digest", "sub"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
            .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))
    return pair.unionByName(term)
