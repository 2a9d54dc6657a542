"""The pipeline against a chain of brute-force stages; operators on tables that carry their own names."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from insight.llm import byte_bpe, decontamination, quality_rules, sharding, simhash
from llm_fixtures import documents, shared  # noqa: F401
from test_near_duplicates import brute_components, brute_fingerprint

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASHES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "_words", "_twice", "base_failed", "kept", "_key", "_n",
           "_bad", "key", "check", "ids", "decoded", "_s", "_h", "_b", "_p", "_f", "_all", "_r", "_off", "in0_", "fp", "row", "a.b", "id", "i", "body")


@pytest.fixture
def clashing(shared, documents):
    """Rows long enough to be kept, edge rows, and columns of the operators' own names."""
    rng = random.Random(4)
    words = [f"word{k}" for k in range(300)]
    kept = [(100 + i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    kept += [(200, kept[3][1]), (201, kept[3][1]), (201, kept[3][1]), (None, kept[5][1] + " more"), (202, kept[7][1] + " ten words of the benchmark item that must be found here")]
    rows = documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(shared.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in kept], "doc_id long, text string, lang string, source string, n_chars long"))
    return rows.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])


@pytest.fixture
def folder(shared, clashing, tmp_path):
    clashing.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    shared.createDataFrame([(7, "Ten words of the benchmark, item that must be found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared.createDataFrame([(100 + i, 1, 0) for i in range(30)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def untouched(rows):
    return all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for c in CLASHES if c in r.__fields__)


def brute_pipeline(rows):
    """rows: (id, text); the labelled rows are all good, so no rule is learned."""
    kept = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        twice = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        if len(words) >= 50 and 100 * len(twice) <= 50 * len(words):
            kept.append((i, text))
    far = 1 << 60
    marked = [(far if i is None else i, brute_fingerprint(t), t) for i, t in kept]
    low = brute_components([(i, f) for i, f, _ in marked])
    one = {i: t for i, f, t in marked if low[i] == i}
    windows = ["ten words of the benchmark item that must be found"]
    clean = {i: t for i, t in one.items() if not any(w in " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())) for w in windows)}
    ranks = byte_bpe.PrefixBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN).ranks
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in clean.items():
        ids = lib.encode_ordinary(t)
        out.append((-1 if i == far else i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_pipeline_against_a_chain_of_brute_force_stages(shared, clashing, folder):
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:4]) for r in corpus_pipeline.run(shared, folder).collect())
    assert got == brute_pipeline([(r.doc_id, r.text) for r in clashing.collect()]) and len(got) > 30


def test_stages_keep_columns_of_any_name(shared, clashing, folder):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(shared, docs, folder)
        assert docs.columns == clashing.columns, name
        assert untouched(docs.collect()), name
    assert corpus_pipeline.STAGES[-1][1](shared, docs, folder).count() == docs.count()


def test_stages_of_an_empty_table(shared, clashing, folder):
    docs = clashing.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(shared, docs, folder)
        assert docs.collect() == [], name


def test_operators_lose_no_column(shared, clashing):
    placed = sharding.interleave(clashing.withColumn("slot", F.lit("x")), 5)
    assert placed.columns == [*clashing.columns, "shard", "slot"] and untouched(placed.collect())
    told = quality_rules.judge(clashing, [])
    assert untouched([r for r in told.drop("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()])
    assert told.where("kept").count() > 30
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(clashing, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    rows = coded.collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows) and untouched(coded.drop("ids", "decoded").collect())
    left = simhash.one_of_each(clashing, 3)
    assert left.columns == clashing.columns and untouched(left.collect())


def test_equal_keys_of_other_texts_stay_apart(shared, monkeypatch):
    """Rows whose first hash is equal: only the one with the benchmark's words goes."""
    both = (F.lit(5).cast("long").alias("key"), F.xxhash64("text", "doc_id").alias("check"))
    monkeypatch.setattr(decontamination, "identity", lambda: both)
    real = decontamination.word_positions
    monkeypatch.setattr(decontamination, "word_positions", lambda d: real(d).withColumn("key", F.lit(5).cast("long")))
    docs = shared.createDataFrame([(1, "a b c d e f g h i j k"), (2, "nothing of the kind")], "doc_id long, text string")
    items = shared.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.without_matches(docs, items).collect()] == [2]


def test_equal_ids_spread_over_buckets(shared):
    rows = shared.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("v"))
    placed = sharding.interleave(rows, 8, buckets=16)
    assert placed.groupBy("shard").count().agg(F.min("count"), F.max("count")).first()[:] == (2500, 2500)
    assert sorted(r.v for r in placed.collect()) == list(range(20_000))
