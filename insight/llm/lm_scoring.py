"""Stupid-backoff language-model scores, computed relationally from n-gram counts partitioned by hash.

Texts are split into words once: a slice of texts is stored as numbers into the slice's own list of words.  The words'
counts over all documents form the first count table, partitioned by hash and joined back to the slices' lists, so
that every place knows how often its word and the word before occur.

Texts are then exploded to their places (one row per text and different n-gram), which carry the hash of the pair that
ends there and, per longer order, of the context.  Rows partitioned by context have the counts of the context and of
the n-grams that go on from it on the same machine: an n-gram that occurs often enough gets its score there, the rest
goes on to the order below, down to pairs and to the word alone; in the end the scores are summed per text.  So a row
moves once an order, with no table of n-grams beside it.

An n-gram and all that its score hangs on share the word before the last.  Places are therefore dealt by that word's
hash into passes that need nothing of each other: a pass moves its part of the rows, stores its sums per text, and its
shuffle files go before the next pass.  All work grows in proportion to the texts; passes bound how much of it is on
disk at once, and cost a reading of the stored numbers each.  Equal texts collapse per slice before anything moves.

Score of a word after ``order - 1`` others: count(n-gram) / count(context) if the n-gram occurs at least
``min_count`` times, else ``BACKOFF`` times the score in the shorter context, down to count(word) / all words.
N-grams of two words are told apart by 64-bit hashes, longer ones by two of them, texts by 128 bits.  Logarithms are
added up as whole millionths, so that the sum does not depend on the order.

Words are runs without ASCII white space, A-Z in lower case.  Defined results: a text without words (null, empty)
has zero words, score zero and a null mean; repeated rows are counted and scored each; rows with a null id too; an
empty table gives no rows.  ``doc_id`` may have any type, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insight.llm.storage import stored

BACKOFF, MICRO = 0.4, 1_000_000
BACK = int(round(np.log(BACKOFF) * MICRO))
#: Text (a longer one is a slice of its own) and rows of a slice, and rows that a task sends at a time.
SLICE_BYTES, SLICE_ROWS, ROWS_OUT = 16 << 20, 1 << 24, 50_000
#: Passes over the places at most, and words that are not worth another pass.
PASSES, PASS_WORDS = 10, 2_000_000
#: A text's number: the slice's (its task's, and its own in the task's), and its own in the slice.
IN_TASK, IN_SLICE = 14, 24
#: A word's ``v``: its count, above this many bits of its score in millionths with the sign off (2 ** 38 words make 26,400,000).
SCORE_BITS = 25
LOW = (1 << SCORE_BITS) - 1
#: A row's ``w``: copies of the text, places of the n-gram in it, words of the n-gram.
PLACE_BITS, ORDER_BITS = 31, 6
_ZSTD = pa.Codec("zstd")
_SLICE = pa.schema([("slice", pa.int64()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    ("numbers", pa.binary()), ("words", pa.binary()), ("times", pa.binary())])


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the values."""
    return _ZSTD.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), asbytes=True)


def _unpacked(packed: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_ZSTD.decompress(packed, size * width, asbytes=True), dtype=np.uint8).reshape(width, size).T).view(kind).ravel()


def _slice(number: int, texts: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    """The row of a slice, of its texts' keys and copies; none if they have no words."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(list(texts), type=pa.large_string())))
    some = pc.not_equal(lower, "")
    words = pc.ascii_split_whitespace(lower.filter(some))
    if not len(words):
        return
    lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    k1, k2, copies = np.array(list(texts.values()), dtype=np.int64)[some.to_numpy(zero_copy_only=False)].T
    del lower, words
    own = coded.indices.to_numpy()
    times = np.bincount(own, weights=np.repeat(copies, lengths) if copies.max() > 1 else None).astype(np.int64)
    # frequent words first, for smaller numbers; number 0 is a text's end
    by = np.argsort(-times, kind="stable")
    rank = np.empty(len(by), dtype=np.int32)
    rank[by] = np.arange(1, len(by) + 1)
    inside = np.ones(len(own) + len(lengths), dtype=bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    numbers = np.zeros(len(inside), dtype=np.int32)
    numbers[inside] = rank[own]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(by))
    row = [number, k1, k2, copies, lengths, _packed(numbers), hashes[by].tobytes(), _packed(times[by])]
    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _SLICE)], schema=_SLICE)


def _encoded(texts: DataFrame) -> DataFrame:
    """A row per slice: the texts' keys, copies, words and these words' numbers, then the hashes of the words by number and how often each occurs."""
    most, rows = SLICE_BYTES, SLICE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << IN_TASK
        own: dict[str, list[int]] = {}
        size = seen = 0
        for batch in batches:
            for text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2"))):
                known = own.setdefault(text, [k1, k2, 0])
                known[2] += 1
                seen += 1
                size += len(text.encode()) if known[2] == 1 else 0
                if size >= most or seen >= rows:
                    yield from _slice(number, own)
                    own, size, seen, number = {}, 0, 0, number + 1
                    pa.default_memory_pool().release_unused()
        yield from _slice(number, own)

    return texts.select("text", "k1", "k2").mapInArrow(
        run, "slice long, k1 array<long>, k2 array<long>, copies array<long>, lengths array<long>, numbers binary, words binary, times binary")


def _sent(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), ROWS_OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + ROWS_OUT].view(np.int64)) for c in columns], names=names)


def _listed(slices: DataFrame) -> DataFrame:
    """A row per slice and word: its number ``at``, from 0, its hash ``h`` and how often it occurs there, ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, times in zip(*(batch.column(c).to_pylist() for c in ("slice", "words", "times"))):
                h = np.frombuffer(words, dtype=np.int64)
                yield from _sent(["slice", "at", "h", "n"], [np.full(len(h), number), np.arange(len(h)), h, _unpacked(times, np.int64, len(h))])

    return slices.select("slice", "words", "times").mapInArrow(run, "slice long, at long, h long, n long")


def _micro(part, whole):
    return F.rint(F.log(part / whole) * F.lit(float(MICRO))).cast("long")


def _words(slices: DataFrame) -> int:
    """Words of all texts."""
    per_text = F.zip_with("lengths", "copies", lambda a, b: a * b)
    return slices.agg(F.sum(F.aggregate(per_text, F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0


def _numbered(texts: DataFrame) -> DataFrame:
    """The slices with ``v`` of every word: its count over all texts and its score."""
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in ("slice", "at", "v")] for batch in batches if batch.num_rows]
        if not parts:
            return
        number, at, v = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((at, number))
        head = np.flatnonzero(np.diff(number[by], prepend=number[by[0]] - 1))
        for own in np.split(by, head[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(number[own[:1]]), pa.array([_packed(v[own])], pa.binary())], names=["slice", "v"])

    slices = stored(_encoded(texts), "lm-slices", free=True)
    lists = _listed(slices).withColumn("n", F.sum("n").over(Window.partitionBy("h")))
    v = F.shiftleft("n", SCORE_BITS).bitwiseOR(-_micro(F.col("n"), F.lit(max(1, _words(slices)))))
    lists = lists.select("slice", "at", v.alias("v")).repartition("slice").mapInArrow(gathered, "slice long, v binary")
    return stored(slices.drop("times").join(stored(lists, "lm-lists", free=True), "slice"), "lm-numbered", free=True)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = np.zeros(len(a), dtype=np.uint64)
    for h in (a, b):
        key = (key ^ h) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _exploded(texts: DataFrame, order: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Per text of a slice and different n-gram that ends in it: the text's number ``t``, ``w``, ``v`` of the last word with
    the count of the word before, the hash ``x2`` of the last two words, that of the ``k - 1`` words before the last as
    ``xk``, and the places ``n``.  A text's end is a place too, of ``n`` 0: what stands before it is a context once more.
    Rows of pass ``part`` of ``parts``, of texts or of what ``_numbered`` makes of them."""
    names = ["t", "w", "v", "x2", *[f"x{k}" for k in range(3, order + 1)]]
    high, salt = np.int64(~LOW), np.uint64(0xD6E8FEB86659FD93)

    def rows(number: int, copies: np.ndarray, lengths: np.ndarray, numbers: bytes, words: bytes, v: bytes) -> Iterator[pa.RecordBatch]:
        hashes = np.r_[salt, np.frombuffer(words, dtype=np.uint64)]
        v = np.r_[1 << SCORE_BITS, _unpacked(v, np.int64, len(hashes) - 1)]
        numbers = _unpacked(numbers, np.int32, int(lengths.sum()) + len(lengths))
        starts = np.cumsum(lengths + 1) - lengths - 1
        dealt = (hashes >> np.uint64(33)) % np.uint64(parts) == part
        dealt[0] = False
        mine = dealt[numbers]
        # a first word has its own pass, any other place that of the word before
        spot = np.r_[starts[mine[starts]], np.flatnonzero(mine) + 1]
        owner = np.searchsorted(starts, spot, side="right") - 1
        place = spot - starts[owner]
        # the end matters to contexts of two words or more
        keep = (numbers[spot] != 0) | ((place >= 2) & (order > 2))
        spot, owner, place = spot[keep], owner[keep], place[keep]
        if not len(spot):
            return
        last, before = numbers[spot], numbers[np.maximum(spot - 1, 0)]
        h, context = hashes[last], hashes[before]
        first = np.flatnonzero(place == 0)
        pair = _mixed(context, h)
        pair[first] = _mixed(h[first], h[first] ^ salt)
        keys = [pair]
        for k in range(3, order + 1):
            # short n-grams have no context of this length; they get a key that no other row has for it
            context = _mixed(hashes[numbers[np.maximum(spot - (k - 1), 0)]], context)
            short = np.flatnonzero(place < k - 1)
            keys.append(context.copy())
            keys[-1][short] = _mixed(pair[short], ~pair[short])
        both = (v[before] & high) | (v[last] & LOW)
        both[first] = 1 << SCORE_BITS | (v[last[first]] & LOW)
        # the same n-gram of a text once; should two n-grams meet in the number that sorts them, some rows are left apart, with the same sums
        sorted_by = owner.astype(np.uint64)
        for x in keys:
            sorted_by = (sorted_by ^ x) * np.uint64(0x9E3779B97F4A7C15)
        by = np.argsort(sorted_by)
        new = np.ones(len(by), dtype=bool)
        new[1:] = owner[by[1:]] != owner[by[:-1]]
        for x in keys:
            new[1:] |= x[by[1:]] != x[by[:-1]]
        head = np.flatnonzero(new)
        places = np.zeros(len(by), dtype=np.int64)
        places[by[head]] = np.diff(np.r_[head, len(by)])
        one = np.flatnonzero(places)
        n = np.where(last[one] == 0, 0, places[one])
        w = ((copies[owner[one]] << PLACE_BITS | n) << ORDER_BITS) | np.minimum(place[one] + 1, order)
        yield from _sent(names, [(number << IN_SLICE) + owner[one], w, both[one], *[x[one] for x in keys]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, numbers, words, v = (batch.column(c)[k].as_py() for c in ("slice", "numbers", "words", "v"))
                yield from rows(number, *(batch.column(c)[k].values.to_numpy() for c in ("copies", "lengths")), numbers, words, v)

    if order >= 1 << ORDER_BITS:
        raise ValueError(f"order {order} is not below {1 << ORDER_BITS}")
    slices = texts if "numbers" in texts.columns else _numbered(texts)
    out = slices.select("slice", "copies", "lengths", "numbers", "words", "v").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return out.withColumn("n", _places())


def _places():
    return F.shiftright("w", ORDER_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def _summed(places: DataFrame, order: int, min_count: int) -> DataFrame:
    """``log_micro`` per text ``t`` of the places given.  ``v`` turns from counts (above 0) to the score."""
    v, size = F.col("v"), F.col("w").bitwiseAND(F.lit((1 << ORDER_BITS) - 1).cast("long"))
    counted = F.sum(_places() * F.shiftright("w", ORDER_BITS + PLACE_BITS))
    all_copies = F.sum(F.greatest(_places(), F.lit(1).cast("long")) * F.shiftright("w", ORDER_BITS + PLACE_BITS))

    def decided(k: int, gram, context):
        return F.when((v > 0) & (size >= k) & (gram >= min_count), _micro(gram, context) + BACK * (size - k)).otherwise(v)

    places = places.drop("n")
    for k in range(order, 2, -1):
        context = f"x{k}"
        places = places.repartition(context).withColumn("whole", all_copies.over(Window.partitionBy(context))).withColumn("gram", counted.over(Window.partitionBy(context, "x2")))
        places = places.withColumn("v", decided(k, F.col("gram"), F.col("whole"))).drop("gram", "whole", context)
    places = places.where(_places() > 0)
    if order > 1:
        places = places.withColumn("gram", counted.over(Window.partitionBy("x2"))).withColumn("v", decided(2, F.col("gram"), F.shiftright(v, SCORE_BITS)))
    score = F.when(v > 0, BACK * (size - 1) - v.bitwiseAND(F.lit(LOW).cast("long"))).otherwise(v)
    return places.groupBy("t").agg(F.sum(_places() * score).alias("log_micro"))


def score(docs: DataFrame, order: int = 3, min_count: int = 2) -> DataFrame:
    """``doc_id``, ``n_words`` and ``log_micro`` (sum of log scores in millionths) of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    slices = _numbered(rows)
    parts = min(PASSES, max(1, -(-_words(slices) // PASS_WORDS)))
    sums = reduce(DataFrame.unionByName, [stored(_summed(_exploded(slices, order, part, parts), order, min_count), "lm-sums", free=True) for part in range(parts)])
    sums = sums.groupBy("t").agg(F.sum("log_micro").alias("log_micro"))
    keyed = slices.select("slice", F.posexplode(F.arrays_zip("k1", "k2", "lengths")).alias("at", "k")).select(
        (F.shiftleft("slice", IN_SLICE) + F.col("at")).alias("t"), "k.k1", "k.k2", F.col("k.lengths").alias("n_words"))
    # a text that several slices have got the same sums in each
    per_text = keyed.join(sums, "t").groupBy("k1", "k2").agg(F.first("n_words").alias("n_words"), F.first("log_micro").alias("log_micro"))
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "k1", "k2").join(per_text, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("n_words", none).alias("n_words"), F.coalesce("log_micro", none).alias("log_micro"))


def score_documents(docs: DataFrame, order: int = 3, min_count: int = 2) -> DataFrame:
    """Sum and mean of the words' log scores of every document."""
    mean = F.when(F.col("n_words") > 0, F.col("log_micro") / F.col("n_words") / F.lit(float(MICRO)))
    return score(docs, order, min_count).select("doc_id", "n_words", "log_micro", mean.alias("mean_log_score"))
