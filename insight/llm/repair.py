"""Token ids in grammar-compressed shards (Re-Pair).

Documents in ascending order of id are cut into shards of about ``SHARD_TOKENS`` ids.  Within a shard,
frequent pairs of neighbouring symbols are replaced by new symbols, round by round, until no pair is
frequent; the rules, the symbols' expansion lengths and the last sequence make the shard's record.  With
the lengths, any range of ids is found by a search and only the symbols that cover it are expanded.

Parts are ranges of ids: one shuffle by range brings their rows together, sorted, in streams that are encoded and
compressed with one shard held at a time.  Shards are rows of a Parquet folder, so that Spark's writers commit
them and a repeated task leaves nothing behind.

Defined results: a null text has the end id alone; null ids come first; rows of equal ids are ordered by a hash
of their texts; an empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.llm.storage import stage_folder

#: Ids of a shard before it is closed, and bytes of text of one part.
SHARD_TOKENS, PART_BYTES = 1 << 19, 32 << 20
#: Entries of one generation of a worker's memo (about 250 bytes each), and the characters of its longest key.
MEMO_ENTRIES, LONGEST_IN_MEMO = 150_000, 64
#: Bytes of text encoded at once.
BLOCK = 1 << 20
#: First symbol that is a rule; least uses of a pair; pairs replaced in one round.
FIRST_RULE, LEAST_USES, PAIRS = 1 << 16, 8, 4096
#: Buckets (as a power of two) in which pairs are counted first.
BUCKET_BITS = 18

SHARD = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    T.StructField("n_tokens", T.LongType()), T.StructField("rules", T.BinaryType()),
    T.StructField("lengths", T.BinaryType()), T.StructField("sequence", T.BinaryType())])


def frequent_pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to be replaced now (sorted, both symbols in 64 bits), and the places of all their uses with their numbers.

    Counts of hash buckets tell first which pairs may reach ``LEAST_USES``; only those are counted one by one.
    """
    bucket = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
    at = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= LEAST_USES)[bucket])
    bucket, pairs = bucket[at], seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    first = np.zeros(1 << BUCKET_BITS, dtype=np.uint64)
    first[bucket] = pairs
    plain = first[bucket] == pairs  # one pair of each bucket is counted by the bucket, any other by sorting
    counts = np.bincount(bucket[plain], minlength=1 << BUCKET_BITS)
    filled = np.flatnonzero(counts >= LEAST_USES)
    others, other_uses = np.unique(pairs[~plain], return_counts=True)
    found, uses = np.concatenate([first[filled], others]), np.concatenate([counts[filled], other_uses])
    most = int(uses.max(initial=0))
    least = max(LEAST_USES, most // 64, int(np.partition(uses, -PAIRS)[-PAIRS]) if len(uses) > PAIRS else 0)
    chosen = np.flatnonzero(uses >= least)
    order = np.argsort(found[chosen])
    frequent = found[chosen[order]]
    number = np.full(len(found), -1, dtype=np.int64)
    number[chosen[order]] = np.arange(len(order))
    by_bucket = np.full(1 << BUCKET_BITS, -1, dtype=np.int64)
    by_bucket[filled] = number[:len(filled)]
    rank = by_bucket[bucket]
    rank[~plain] = number[len(filled):][np.searchsorted(others, pairs[~plain])]
    kept = np.flatnonzero(rank >= 0)
    return frequent, at[kept], rank[kept]


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, rules (two symbols each) and expansion lengths of the rules.

    Of the places of frequent pairs at least half are kept, four a pair on average, so every round shortens the sequence.
    """
    seq, rules, lengths = ids.astype(np.uint32), np.empty((0, 2), dtype=np.uint32), np.ones(FIRST_RULE, dtype=np.int64)
    while len(seq) >= 2:
        frequent, at, rank = frequent_pairs(seq)
        if not len(frequent):
            break
        # of overlapping places every second one counts, from the left
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        odd = (np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))) % 2 == 0
        at, rank = at[odd], rank[odd]
        used = np.bincount(rank, minlength=len(frequent)) > 1
        at, rank = at[used[rank]], rank[used[rank]]
        seq[at] = (np.cumsum(used) - 1 + FIRST_RULE + len(rules))[rank]
        left = np.ones(len(seq), dtype=bool)
        left[at + 1] = False
        seq = seq[left]
        new = np.stack([frequent[used] >> np.uint64(32), frequent[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, lengths[new].sum(axis=1)])
    return seq, rules, lengths[FIRST_RULE:]


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that ``seq`` stands for."""
    while len(seq) and (rule := seq >= FIRST_RULE).any():
        begins = np.cumsum(1 + rule) - (1 + rule)
        out = np.empty(int(begins[-1]) + 1 + int(rule[-1]), dtype=np.uint32)
        out[begins] = np.where(rule, rules[np.where(rule, seq - FIRST_RULE, 0), 0] if len(rules) else seq, seq)
        out[begins[rule] + 1] = rules[seq[rule] - FIRST_RULE, 1]
        seq = out
    return seq


def expand_all(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for a whole shard: every rule is expanded once, and the ids are gathered from these expansions."""
    flat = np.concatenate([np.arange(FIRST_RULE, dtype=np.uint32), expand(np.arange(len(rules), dtype=np.uint32) + np.uint32(FIRST_RULE), rules)])
    size = np.concatenate([np.ones(FIRST_RULE, dtype=np.int64), lengths])
    each = size[seq]
    ends = np.cumsum(each)
    return flat[np.repeat((np.cumsum(size) - size)[seq] - ends + each, each) + np.arange(each.sum())]


def decode_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, count: int) -> np.ndarray:
    """``count`` ids from ``start`` on, expanding only the symbols that cover them."""
    each = np.ones(len(seq), dtype=np.int64)
    rule = seq >= FIRST_RULE
    each[rule] = lengths[seq[rule] - FIRST_RULE]
    ends = np.cumsum(each)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left")
    before = int(ends[first - 1]) if first else 0
    return expand(seq[first:last + 1], rules)[start - before:start - before + count]


#: Letters, numbers and white space among the characters up to U+024F (fixed values).
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\0-ɏ]").search
_LATIN = re.compile(f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
                    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


#: Places that no match of the split pattern reaches over: before a single white-space character between two others, and
#: after a single newline there.
_SEAM = regex.compile(r"(?<=\S)(?=\s\S)|(?<=\S\n)(?=\S)")


def blocks(text: str, size: int) -> Iterator[str]:
    """Cut a long text into blocks of ``size`` characters or a little more, at ``_SEAM`` only."""
    at = 0
    while len(text) - at > size and (seam := _SEAM.search(text, at + size)):
        yield text[at:seam.start()]
        at = seam.start()
    yield text[at:]


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class _Memo(dict):
    """Packed ids by chunk; of two generations the elder goes when the younger is full, so what is met often stays."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.learn(chunk)
        if len(chunk) <= LONGEST_IN_MEMO:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class _Words:
    """The tokenizers library with memos of what it has encoded.

    A text of Latin letters is cut into the matches of the split pattern, which go to the library's BPE model at once.
    Another is cut at ``_SEAM`` and its chunks pass the whole tokenizer, as does a text with an added token in it.
    """

    def __init__(self, tokenizer_json: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        told = json.loads(tokenizer_json)
        splits = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer with its own split pattern is needed")
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.space = chr(self.letters[32])
        self.young, self.chunks = _Memo(self._piece), _Memo(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            mapped = self.space + piece[1:]
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _text(self, text: str) -> bytes:
        if any([a in text for a in self.added]):
            return self._whole(text)
        if _BEYOND(text) is None:
            return b"".join(map(self.young.__getitem__, _LATIN.findall(text)))
        return b"".join(map(self.chunks.__getitem__, _SEAM.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 16-bit ids of each text."""
        return [self._text(t) if t else b"" for t in texts]


_TOKENIZERS: dict[int, _Words] = {}


def _tokenizer(content: bytes) -> _Words:
    """One tokenizer and memo per Python worker and vocabulary."""
    key = zlib.crc32(content)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = _Words(content)
    return _TOKENIZERS[key]


def _encoded(batch: pa.RecordBatch, content: bytes, text: str, end: bytes) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of ``batch`` of about ``BLOCK`` bytes of text with the packed ids of their texts, each with ``end``."""
    encode = _tokenizer(content).encode
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + BLOCK, "right")))
        rows = batch.slice(at, to - at)
        texts = rows.column(text).to_pylist()
        if len(texts) == 1 and texts[0] and len(texts[0]) > BLOCK:
            ids = [b"".join([encode([block])[0] for block in blocks(texts[0], BLOCK)])]
        else:
            ids = encode(texts)
        yield rows, [i + end for i in ids]
        at = to


def _shards(content: bytes, end: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part (``part``, ``doc_id``, ``text``), sorted -> its shards, one at a time."""
    number, docs, packed, held = 0, [], [], 0

    def close(part: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(packed), dtype="<u2")
        seq, rules, lengths = compress(ids)
        return pa.RecordBatch.from_pylist([{
            "part": part, "shard": number, "doc_ids": docs, "doc_tokens": [len(p) // 2 for p in packed], "n_tokens": len(ids),
            "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
            "sequence": seq.astype("<u4").tobytes()}], schema=_ARROW)

    part = 0
    for batch in batches:
        for rows, encoded in _encoded(batch, content, "text", end):
            part = rows.column("part")[0].as_py()
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encoded):
                if held >= SHARD_TOKENS:
                    yield close(part)
                    number, docs, packed, held = number + 1, [], [], 0
                docs.append(doc)
                packed.append(ids)
                held += len(ids) // 2
    if docs:
        yield close(part)


_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
                    ("n_tokens", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> str:
    """Encode ``docs`` (``doc_id``, ``text``; default settings of the library) and write their shards; returns the folder.

    Parts are ranges of (id, hash of the text), so that an id with many rows is split as well; one shuffle moves the
    texts, and one Python stage encodes, compresses and writes a part.
    """
    path = path or stage_folder(docs.sparkSession, "repair-shards")
    content, end = Path(tokenizer_path).read_bytes(), np.array([end_id], dtype="<u2").tobytes()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // PART_BYTES)), *order).sortWithinPartitions(*order, "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    rows.mapInArrow(partial(_shards, content, end), SHARD).write.parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = expand_all(np.frombuffer(row["sequence"], dtype="<u4"), np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2),
                             np.frombuffer(row["lengths"], dtype="<u4"))
            ends = np.cumsum(row["doc_tokens"])
            starts = ends - row["doc_tokens"]
            offsets = np.concatenate([[0], 4 * ends]).astype("<i4")
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([row["part"]] * len(ends), pa.int32()), "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": pa.array(starts, pa.int64()),
                "ids": pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])})


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents of stored shards: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (32-bit) and their checksum.

    Starts are prefix sums over the parts (one row each) and over the shards of a part.
    """
    sizes = shards.select("part", "shard", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = by_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    within = Window.partitionBy("part").orderBy("shard")
    offsets = sizes.select("part", "shard", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("inside")).join(before, "part")
    docs = shards.mapInArrow(_read, "part int, shard int, doc_id long, within long, ids binary").withColumns(
        {"n_tokens": F.expr("octet_length(ids) div 4").cast("long"), "ids_crc32": F.crc32("ids")})
    return docs.join(offsets, ["part", "shard"]).withColumn("start", F.col("before") + F.col("inside") + F.col("within")).select(
        "doc_id", "start", "n_tokens", "ids", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Start, length and checksum of every document's ids, from the files."""
    path = write_shards(docs, tokenizer_path, end_id)
    return read_shards(docs.sparkSession.read.schema(SHARD).parquet(path)).select("doc_id", "start", "n_tokens", "ids_crc32")
