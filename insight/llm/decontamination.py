"""Benchmark decontamination with a distributed positional inverted index.

Benchmark texts are cut into windows of consecutive words.  One pass over the documents counts how often
each benchmark word occurs; every window then names its rarest words.  A second pass posts those words'
positions (document, position, word) in a stored table.  The posting list of a window's rarest word, moved
back by the word's offset, gives the places where the window may begin; they are intersected with the lists
of the next rarest words, and what is left is compared word by word with the whole text.  With a ``slop``
every start within so many words of these is tried, the lists may disagree by so many and every word, the rarest
too, must lie that near to its place (proximity match).

The index holds narrow rows for the words that windows need, so its size follows the documents; the word
tables that are broadcast come from the benchmark and are broadcast only up to ``BROADCAST_BYTES``.  Beyond
it, joins by word are shuffled, where Spark splits skewed partitions.  Only texts with a candidate place are
moved to it; which these are is broadcast under the same check.  Everything is DataFrame functions.

Defined results: a null, empty or wordless text has no words and no hits; a benchmark item without words
has no window; a window of equal words in several items counts for each of them; repeated rows of documents
each get a row, and documents are told apart by id and text together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight.llm.columns import boxed, unboxed
from insight.llm.storage import stored

#: Bytes of benchmark words up to which their table is broadcast.
BROADCAST_BYTES = 16 << 20
#: Lists that are intersected before texts are compared.
LISTS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all of ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` is the fast way for texts of ASCII only."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words of a text as they are written; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _small(df: DataFrame, word: str | None = None) -> DataFrame:
    """``df``, to be broadcast if its measured size allows."""
    size = df.agg(F.sum((F.octet_length(word) if word else F.lit(0)) + F.lit(64))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def benchmark_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``wid``, ``window``) and the items each belongs to (``wid``, ``item_id``)."""
    items = benchmark.select("item_id", F.transform(raw_words(F.col("text")), ascii_lower).alias("words"))
    items = items.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(width), F.lit(0))
    cut = items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, width))).alias("window"))
    ids = stored(cut.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "decontamination-windows")
    owners = stored(cut.join(ids, "window").select("wid", "item_id").distinct(), "decontamination-owners")
    return ids, owners


def identity() -> tuple[Column, Column]:
    """``key`` and ``check``: 128 bits that tell rows of another id or text apart."""
    return F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit("check"), "text", "doc_id").alias("check")


def word_positions(docs: DataFrame) -> DataFrame:
    """Every word of every document: ``key`` (of id and text), ``pos`` from 0, ``word``."""
    told = docs.select(F.xxhash64("doc_id", "text").alias("key"), raw_words(F.col("text")).alias("words"))
    return told.select("key", F.posexplode("words").alias("pos", "raw")).select("key", "pos", ascii_lower(F.col("raw")).alias("word"))


def rarest_words(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The up to ``LISTS`` rarest words of each window that may occur: ``wid``, ``nth``, ``word``, ``offset``."""
    spots = windows.select("wid", F.posexplode("window").alias("offset", "word"))
    vocabulary = spots.select("word").distinct()
    counts = stored(word_positions(docs).join(_small(vocabulary, "word"), "word", "left_semi")
                    .groupBy("word").agg(F.count(F.lit(1)).alias("n")), "decontamination-counts")
    known = spots.join(counts, "word", "left")
    whole = known.groupBy("wid").agg(F.max(F.col("n").isNull()).alias("lacks")).where("not lacks")
    order = Window.partitionBy("wid").orderBy("n", "word", "offset")  # at most as many rows as a window has words
    ranked = known.join(whole, "wid", "left_semi").withColumn("nth", F.row_number().over(order))
    return stored(ranked.where(F.col("nth") <= LISTS).select("wid", "nth", "word", "offset"), "decontamination-rarest")


def matches(docs: DataFrame, windows: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Candidate places (``key``, ``wid``, ``start``) after intersecting lists, and the stored index."""
    rare = rarest_words(docs, windows)
    terms = rare.select("word").distinct()
    index = stored(word_positions(docs).join(_small(terms, "word"), "word", "left_semi"), "decontamination-index")
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    first = _small(rare.where("nth = 1"), "word")
    found = index.join(first, "word").select("key", "wid", (F.col("pos") - F.col("offset")).alias("start"))
    if slop:  # the rarest word may be shifted as any other
        found = found.select("key", "wid", "start", near.alias("shift")).select("key", "wid", (F.col("start") + F.col("shift")).alias("start")).distinct()
    found = found.where(F.col("start") >= -slop)
    for nth in range(2, LISTS + 1):
        wanted = rare.where(F.col("nth") == nth).select("wid", "word", "offset")
        asked = found.join(_small(wanted, "word"), "wid", "left")
        asked = asked.select("key", "wid", "start", "word", "offset", near.alias("shift"))
        settled = asked.where("word is null")  # a window of fewer words
        agreed = asked.where("word is not null").withColumn("pos", F.col("start") + F.col("offset") + F.col("shift")).join(
            index, ["key", "word", "pos"], "left_semi")
        found = agreed.unionByName(settled.withColumn("pos", F.lit(None).cast("int"))).select("key", "wid", "start")
        if slop:
            found = found.distinct()
    return found, index


def verified(docs: DataFrame, benchmark: DataFrame, width: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """Texts with a match: ``key``, ``check`` (hashes of id and text), ``matches`` (start, wid, length, exact) and ``n_hit``, the
    words inside any match; and the items of the windows."""
    windows, owners = benchmark_windows(benchmark, width)
    found, _ = matches(docs, windows, slop)
    found = stored(found, "decontamination-candidates")
    spots = (found.join(windows, "wid").groupBy("key")
             .agg(F.collect_set(F.struct("start", "wid", "window")).alias("spots")))
    keyed = docs.select("text", *identity())
    asked = keyed.join(_small(found.select("key").distinct()), "key", "left_semi").join(spots, "key")
    asked = asked.select("key", "check", "spots", F.transform(raw_words(F.col("text")), ascii_lower).alias("words"))

    def exact(s: Column) -> Column:
        return (s["start"] >= 0) & (F.slice("words", F.greatest(s["start"], F.lit(0)) + 1, F.size(s["window"])) == s["window"])

    def close(s: Column) -> Column:
        return F.forall(F.transform(s["window"], lambda w, i: F.array_contains(F.slice(
            "words", F.greatest(s["start"] + i - slop, F.lit(0)) + 1,
            F.greatest(F.lit(0), F.least(F.lit(2 * slop + 1), s["start"] + i + slop + 1))), w)), lambda x: x)

    kept = F.filter("spots", (lambda s: exact(s) | close(s)) if slop else exact)
    asked = asked.select("key", "check", F.size("words").alias("n"), F.array_sort(F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), s["wid"].alias("wid"), F.size(s["window"]).alias("length"), exact(s).alias("exact")))).alias("matches"))
    covered = F.aggregate(
        "matches", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, m: F.struct(
            (acc["n"] + F.greatest(F.lit(0), F.least(m["start"] + m["length"], F.col("n")) - F.greatest(acc["end"], m["start"]))).alias("n"),
            F.greatest(acc["end"], m["start"] + m["length"]).alias("end")),
        lambda acc: acc["n"])
    told = stored(asked.select("key", "check", "matches", covered.cast("long").alias("n_hit")), "decontamination-hits")
    return told.where("n_hit > 0").dropDuplicates(["key", "check"]), owners


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``key``) with its words, hits, verified ``matches`` and matched ``items``,
    sorted as strings."""
    hits, owners = verified(docs, benchmark, width, slop)
    keyed = docs.select("doc_id", "text", *identity())
    owned = (hits.select("key", "check", F.explode("matches.wid").alias("wid")).distinct()
             .join(owners, "wid").groupBy("key", "check")
             .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    told = keyed.select("doc_id", "key", "check", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = told.join(hits.join(owned, ["key", "check"]), ["key", "check"], "left")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("matches", F.array().cast(hits.schema["matches"].dataType)).alias("matches"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose text has no match."""
    bad = verified(docs.select("doc_id", "text"), benchmark, width, slop)[0].select("key", "check")
    rows = boxed(docs, doc_id="doc_id", text="text").select("*", *identity())
    return unboxed(rows.join(_small(bad), ["key", "check"], "left_anti"), docs.columns)


def decontamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Counts and the digest of the matched items of every document."""
    out = contamination(docs, benchmark, width)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
