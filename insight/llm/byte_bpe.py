"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the token ``t``
that is a suffix of the prefix and *fits* the last token of the prefix before it.  Two tokens fit when
merging their joined bytes gives back just the two of them.  Storing that last token per prefix
(``last_tokens``) makes the encoding of every prefix available by walking backwards, so bytes can be
appended exactly, and an edit recomputes only what follows it within the pieces it touches
(``EncodedText.edit``).

``encode_documents`` / ``decode_documents`` apply this to a column with Arrow batches: rows are
independent, so there is no shuffle and a lost executor only repeats its own tasks.  Each Python worker
keeps a bounded memo of chunks it has met; the memo never changes a result.

Defined results: a null text encodes as the empty text (no ids, decoded to the empty text); repeated rows
give repeated results; an empty table gives no rows; other columns pass through unchanged, and a column of an
output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.llm.columns import boxed, unboxed

#: Entries of one generation of a worker's memo (about 250 bytes each), and the characters of its longest key.
MEMO_ENTRIES, LONGEST_IN_MEMO = 150_000, 64
#: Rows that a worker encodes at once.
ROWS = 256
NEVER = 1 << 62


def read_ranks(path: str) -> bytes:
    """Content of a rank file (base64 token, space, rank per line); its size is bounded by the vocabulary."""
    return Path(path).read_bytes()


class PrefixBpe:
    """Encoder for one rank file and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token_bytes = {r: b for b, r in self.ranks.items()}
        self.lengths = {r: len(b) for b, r in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in self.ranks.items():
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """Plain merging, used only on the bytes of a single vocabulary entry."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if r < best and len(parts) > 2:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one that merging never splits in two."""
        if token not in self._halves:
            parts = self._merge(self.token_bytes[token])
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether encoding the joined bytes of ``a`` and ``b`` gives ``[a, b]`` (``a`` -1: ``b`` alone).

        Going back in time from the finished pair, the token at each side of the seam is undone in
        turn, the younger first.  A merge across the seam must never have come before the merge
        that took one of the two away (at equal rank the left one goes first).
        """
        key = (a + 1) << 32 | b
        if a < 0:
            self._fits[key] = self.halves(b) is not None or self.lengths[b] == 1
            return self._fits[key]
        ok, left, right, left_until, right_until = True, a, b, NEVER, NEVER
        text = self.token_bytes
        while True:
            across = self.ranks.get(text[left] + text[right], NEVER)
            if across < left_until and across <= right_until and across != NEVER:
                ok = False
                break
            lh, rh = self.halves(left), self.halves(right)
            if lh is None and rh is None:
                break
            if rh is None or (lh is not None and left > right):
                left_until, left = left, lh[1]
            else:
                right_until, right = right, rh[0]
        if len(self._fits) > 4 * MEMO_ENTRIES:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """``out[i]``: the token that ends the encoding of ``piece[:i + 1]``.

        ``known`` holds the table of a prefix of ``piece``, which is kept as it is (an exact append).
        The automaton lists the vocabulary entries that end at each byte; exactly one of them fits.
        """
        out = list(known or [])
        done, known_fit, lengths = len(out), self._fits.get, self.lengths
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                start = end - lengths[token]
                before = out[start] if start >= 0 else -1
                ok = known_fit((before + 1) << 32 | token)
                if ok is None:
                    ok = self.fits(before, token)
                if ok:
                    out.append(token)
                    done += 1
        if done < len(piece):
            raise ValueError("the vocabulary lacks single bytes")
        return out

    def walk_back(self, last: list[int]) -> list[int]:
        """Ids of the prefix that ``last`` describes."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.token_bytes[last[end - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.last_tokens(piece))

    def _packed(self, chunk: str) -> bytes:
        """Ids of a chunk or piece that the memo lacks; a chunk's pieces are looked up one by one."""
        pieces = self.split(chunk)
        if len(pieces) > 1:
            return b"".join([self._remembered(p) for p in pieces])
        ids = [i for piece in pieces for i in self.encode_piece(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remembered(self, chunk: str) -> bytes:
        """Look ``chunk`` up; of two generations the elder goes when the younger is full, so what is met often stays."""
        ids = self._young.get(chunk)
        if ids is None:
            ids = self._old.get(chunk) or self._packed(chunk)
            if len(chunk) <= LONGEST_IN_MEMO:
                if len(self._young) >= MEMO_ENTRIES:
                    self._old, self._young = self._young, {}
                self._young[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([self._young.get(c) or self._remembered(c) for c in chunks(text)])

    def decode(self, ids: bytes) -> bytes:
        text = self.token_bytes
        return b"".join([text[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_SEAM = regex.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> list[str]:
    """Cut ``text`` before single spaces between two non-space characters.

    No match of the split pattern reaches over such a place, so chunks can be encoded one by one.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    if all([p and not p[0].isspace() and not p[-1].isspace() for p in parts]):
        return [parts[0], *[" " + p for p in parts[1:]]]
    return _SEAM.split(text)


class EncodedText:
    """One text with its pieces and their prefix tables; supports exact appends and edits."""

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.pieces: list[tuple[str, list[int]]] = []
        self.edit(0, 0, text)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]`` by ``new``; returns how many bytes were encoded anew.

        Pieces that end well before the edit are kept (a piece and its successor may change with the
        text behind them), and so are pieces behind it from the first common boundary on.  In a piece
        that grew, the table of the unchanged prefix is reused.
        """
        old, shift = self.pieces, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        keep, at, bounds = 0, 0, []
        for piece, _ in old:
            bounds.append(at)
            at += len(piece)
        while keep < len(old) and bounds[keep] + len(old[keep][0]) < start:
            keep += 1
        keep = max(0, keep - 2)
        at = bounds[keep] if keep < len(old) else 0
        later = {b + shift: k for k, b in enumerate(bounds) if b > end}
        fresh, spent, tail = [], 0, len(old)
        for m in self.bpe.pattern.finditer(self.text, at):
            if m.start() in later and m.start() > start + len(new):
                tail = later[m.start()]
                break
            raw, known = m.group().encode(), []
            for piece, table in old[keep:keep + len(fresh) + 1][-1:]:
                before = piece.encode()
                same = next((i for i, (x, y) in enumerate(zip(before, raw)) if x != y), min(len(before), len(raw)))
                known = table[:same]
            spent += len(raw) - len(known)
            fresh.append((m.group(), self.bpe.last_tokens(raw, known)))
        self.pieces = old[:keep] + fresh + (old[tail:] if tail < len(old) else [])
        return spent

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        out = []
        for piece, table in self.pieces:
            whole = self.bpe.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.bpe.walk_back(table)
        return out


_ENCODERS: dict[str, PrefixBpe] = {}


def _encoder(rank_file: bytes, pattern: str) -> PrefixBpe:
    """One encoder per Python worker and vocabulary."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixBpe(rank_file, pattern)
    return _ENCODERS[key]


def _with_column(df: DataFrame, column: str, rank_path: str, pattern: str, new: dict[str, Callable]) -> DataFrame:
    """``df`` with the binary columns ``new``, each made by a function of the encoder and the columns so far.

    One Python stage for all of them, so that a task has one worker; rows pass in small batches.
    """
    rank_file = read_ranks(rank_path)
    wide, place = boxed(df), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                values = {column: rows.column(place).to_pylist()}
                for name, make in new.items():
                    values[name] = make(bpe, values)
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(values[n], pa.binary()) for n in new]],
                                                 names=[*rows.schema.names, *new])

    out = wide.mapInArrow(run, T.StructType([*wide.schema.fields, *[T.StructField(n, T.BinaryType()) for n in new]]))
    return unboxed(out, df.columns, *new)


def encode_documents(df: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of ``text`` as packed little-endian unsigned 32-bit integers (binary)."""
    return _with_column(df, text, rank_path, pattern, {
        out: lambda bpe, v: [bpe.encode(t) if t else b"" for t in v[text]]})


def decode_documents(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for."""
    return _with_column(df, ids, rank_path, pattern, {
        out: lambda bpe, v: [bpe.decode(p) if p else b"" for p in v[ids]]})


def token_digests(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id``, token count and digests of ids and decoded bytes of every document."""
    both = _with_column(df.select("doc_id", "text"), "text", rank_path, pattern, {
        "ids": lambda bpe, v: [bpe.encode(t) if t else b"" for t in v["text"]],
        "decoded": lambda bpe, v: [bpe.decode(p) if p else b"" for p in v["ids"]]})
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
