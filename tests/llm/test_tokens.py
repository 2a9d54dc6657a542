"""Byte-level BPE and Re-Pair shards against the libraries, with exact round trips."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from insight.llm import byte_bpe, repair
from llm_fixtures import documents, shared  # noqa: F401

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
BPE = byte_bpe.PrefixBpe(byte_bpe.read_ranks(RANKS), P.PATTERN)
LIBRARY = tiktoken.Encoding("t", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))})


def ids_of(text):
    return np.frombuffer(BPE.encode(text), dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinortsh  \n\t.,'é日"), st.characters(codec="utf-8")), max_size=80))
def test_encoding_equals_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


def test_long_piece_and_spaces():
    for text in ("ab" * 5000, " " * 3000, "x  y  z\x85 \x1c q"):
        assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_prefix_table_gives_every_prefix():
    raw = b"thehestanonere"
    table = BPE.last_tokens(raw)
    for n in range(1, len(raw) + 1):
        assert BPE.walk_back(table[:n]) == LIBRARY.encode_ordinary(raw[:n].decode())
    assert BPE.last_tokens(raw + b"xyz", table) == BPE.last_tokens(raw + b"xyz")


def test_edits_and_appends_are_exact():
    draw = random.Random(5)
    for _ in range(60):
        text = byte_bpe.EncodedText(BPE, "".join(draw.choice(["the ", "an", "é", " \n", "tion", "x", "."]) for _ in range(80)))
        for _ in range(6):
            at = draw.randint(0, len(text.text))
            text.edit(at, min(len(text.text), at + draw.randint(0, 9)), draw.choice(["", "ing", "  ", "\n", " a"]))
            assert text.ids() == LIBRARY.encode_ordinary(text.text)
        text.append(" more of it")
        assert text.ids() == LIBRARY.encode_ordinary(text.text)


def test_edit_recomputes_little():
    text = byte_bpe.EncodedText(BPE, "the rest of it " * 500)
    assert text.edit(3000, 3001, "q") < 100
    assert text.ids() == LIBRARY.encode_ordinary(text.text)


def test_bpe_digest_of_edge_rows(documents):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in byte_bpe.token_digests(documents, RANKS, P.PATTERN).collect())
    want = []
    for r in documents.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.integers(0, 400), st.integers(0, 50))
def test_grammar_round_trip_and_random_access(ids, start, count):
    ids = np.array(ids * 3, dtype="<u2")
    seq, rules, lengths = repair.compress(ids)
    assert repair.expand(seq, rules).tolist() == ids.tolist()
    assert repair.expand_all(seq, rules, lengths).tolist() == ids.tolist()
    count = max(0, min(count, len(ids) - start))
    if count:
        assert repair.decode_range(seq, rules, lengths, start, count).tolist() == ids[start:start + count].tolist()


def test_grammar_replaces_frequent_pairs():
    ids = np.array([5, 6, 7, 8] * 500, dtype="<u2")
    seq, rules, lengths = repair.compress(ids)
    assert len(seq) < 40 and len(rules) >= 2 and lengths.max() >= 4


@pytest.mark.parametrize("ids", [[7] * (1 << 19), list(range(3000)) * 100, [5] * 3000 + list(range(40)) * 2000 + [6] * 70000])
def test_no_frequent_pair_is_left(ids):
    ids = np.array(ids, dtype="<u2")
    seq, rules, lengths = repair.compress(ids)
    assert np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)[1].max() < repair.LEAST_USES
    assert repair.expand_all(seq, rules, lengths).tolist() == ids.tolist()
    assert repair.decode_range(seq, rules, lengths, 1000, 500).tolist() == ids[1000:1500].tolist()


WORDS = repair._Words(open(P.path("byte_bpe_50k.json"), "rb").read())
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Zeß", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "é日", "12", "...", "\x85", "\xa0", "\u3000",
                                          "\x1c", "x" * 70, "<|endoftext|>"]), max_size=25).map("".join), max_size=5))
def test_memo_encoding_equals_library(texts):
    want = [np.array(HF.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    assert WORDS.encode(texts) == want
    for text, ids in zip(texts, want):
        parts = list(repair.blocks(text, 7))
        assert "".join(parts) == text and b"".join(WORDS.encode(parts)) == ids


LATIN = st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(LATIN, st.sampled_from([" don't", "we'll ", " '", "''s", " x² ", "½½", "\x85 \xa0", "  a"])), max_size=6).map("".join))
def test_latin_text_is_cut_as_the_library_does(text):
    assert WORDS.encode([text]) == [np.array(HF.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()]


def test_every_latin_character_is_cut_as_the_library_does():
    for code in range(0x250):
        text = "".join(a + chr(code) + b for a in ("a", "1", " ", ".", "'") for b in ("a", "1", " ", ".", "s"))
        assert WORDS.encode([text]) == [np.array(HF.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()]


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(repair, "MEMO_ENTRIES", 3)
    for text in ("one two three four", "one two five six\nseven", "one " + "y" * 90, "two five"):
        assert WORDS.encode([text]) == [np.array(HF.encode(text).ids, dtype="<u2").tobytes()]
        assert len(WORDS.young) <= 3 and not any(len(c) > repair.LONGEST_IN_MEMO for c in WORDS.young)


@pytest.mark.parametrize("small", [True, False])
def test_token_files(shared, documents, small, monkeypatch):
    if small:
        monkeypatch.setattr(repair, "SHARD_TOKENS", 6)
        monkeypatch.setattr(repair, "PART_BYTES", 6000)
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, start = [], 0
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in repair.token_file_digest(documents, path).collect()), key=key) == want
    assert repair.token_file_digest(documents.limit(0), path).collect() == []
