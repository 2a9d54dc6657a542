"""Toxicity, collocations and source divergence: brute force, planted structure, held-out labels, edge rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from insight.llm import bitfilter, collocations, divergence, toxicity
from llm_fixtures import documents, shared  # noqa: F401

SF01 = "/root/testdata/sf0.01"
FIELDS = "doc_id long, text string, lang string, source string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- collocations -------------------------------------------------------------------------------------------

def brute_collocations(rows, top, least, share):
    """rows: (lang, text)"""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            for k in (1, 2, 3):
                f[lang or "und"].update(words[i:i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        found = {g: c for g, c in count.items() if len(g) > 1 and c >= least}
        alive = []
        for g, a in found.items():
            if len(g) == 2 and any(100 * c >= share * a for x, c in found.items() if len(x) == 3 and g in (x[:2], x[1:])):
                continue
            score, k = min((1000000 * a * a // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g)))
            alive.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(alive)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def made(seed, words=25, n=250):
    rng = np.random.default_rng(seed)
    pool = [f"w{k}" for k in range(words)] + ["Été", "été", "x\x00y"]
    weight = 1 / np.arange(1, len(pool) + 1)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(pool, p=weight / weight.sum(), size=rng.integers(0, 40)))
        for old, new in (("w3 ", "w3, "), ("w5 ", "W5\t"), ("w7 ", "w7\x0b"), ("w2 ", "w2 new york city ")):
            text = text.replace(old, new)
        rows.append((i, text if i % 17 else None, [None, "en", "de"][i % 3], "s"))
    return rows


@pytest.mark.parametrize("top,block", [(5, 50), (12, 10 ** 6), (10 ** 4, 300)])
def test_collocations_against_brute_force(shared, monkeypatch, top, block):
    """Few and all phrases, one and many rounds, small and large blocks; ties at the last place."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    rows = made(top)
    df = shared.createDataFrame(rows, FIELDS).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, top, 10, 50).collect())
    assert got == brute_collocations([(r[2], r[1]) for r in rows], top, 10, 50)


def test_collocations_of_edge_rows_and_an_empty_table(shared, documents):
    want = brute_collocations([(r.lang, r.text) for r in documents.collect()], 2000, 10, 50)
    assert sorted(tuple(r) for r in collocations.collocations(documents).collect()) == want and want
    clash = documents.withColumn("h1", F.lit(1)).withColumn("s", F.lit("x")).withColumn("rank", F.lit(2))
    assert sorted(tuple(r) for r in collocations.collocations(clash).collect()) == want
    assert collocations.collocations(documents.limit(0)).collect() == []


def test_colliding_word_digests_take_another_seed(shared, documents, monkeypatch):
    real = collocations._digest
    monkeypatch.setattr(collocations, "_digest", real)
    words, seed = collocations._unique_digests(documents)
    assert seed == 0 and words.groupBy("h").count().where("count > 1").isEmpty()


def test_filter_holds_every_member(shared):
    rows = [(int(x), int(y)) for x, y in np.random.default_rng(5).integers(-2 ** 63, 2 ** 63 - 1, size=(500, 2))]
    words = bitfilter.build(shared.createDataFrame(rows, "a long, b long"), "a", "b")
    a, b = np.array(rows, dtype=np.int64).T
    assert bitfilter.holds(words, a, b).all() and bitfilter.holds(words, b, a).mean() < 0.1


# --- divergence ---------------------------------------------------------------------------------------------

def brute_divergence(rows, least, top):
    """rows: (text, lang, source)"""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups[lang or ""].add(source or "")
        docs[lang or ""].update(set(terms))
        count[lang or "", source or ""].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})

        def p(c, t, n):
            return 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v)

        size = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        n = sum(size.values())
        for s in sources:
            found = []
            for o in sources - {s}:
                value = 0
                for t in kept:
                    x, y = p(count[lang, s], t, size[s]), p(count[lang, o], t, size[o])
                    value += (x - y) ** 2 // (x + y)
                found.append((-value, o.encode()))
            out += [(lang, s, "pair", o.decode(), -f, k) for k, (f, o) in enumerate(sorted(found), 1)]
            found = []
            for t in kept:
                x, q = p(count[lang, s], t, size[s]), p(whole, t, n)
                if count[lang, s][t] > 0 and x > q:
                    found.append((-((x - q) ** 2 // (x + q)), t.encode()))
            out += [(lang, s, "term", t.decode(), -f, k) for k, (f, t) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made_sources(seed):
    rng = np.random.default_rng(seed)
    pool = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] + ["Ünder", "über"]
    rows = []
    for i in range(220):
        source = [None, "a", "b", "c", "hot", "hot", "hot"][i % 7]
        weight = np.roll(1 / np.arange(1, len(pool) + 1), len(source or ""))
        text = " 1,".join(rng.choice(pool, p=weight / weight.sum(), size=rng.integers(0, 30)))
        rows.append((i, [text, text.upper(), None, text][i % 4], ["en", "de", None, "en"][i % 4 if i % 5 else 2], source))
    rows.append((1000, "only here", "xx", "alone"))
    rows.append((1001, None, "en", "silent"))
    return rows


@pytest.mark.parametrize("bits,block", [(64, 10 ** 6), (64, 40), (5, 100), (1, 10 ** 6)])
def test_divergence_against_brute_force(shared, monkeypatch, bits, block):
    """Wide digests, and narrow ones under which nearly all terms collide and are split by their text."""
    monkeypatch.setattr(divergence, "BLOCK_WORDS", block)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 64)
    rows = made_sources(bits)
    df = shared.createDataFrame(rows, FIELDS).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, 10, 4, bits).collect())
    assert got == brute_divergence([r[1:] for r in rows], 10, 4)


def test_divergence_of_edge_rows_and_an_empty_table(shared, documents):
    documents = documents.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even").when(F.col("doc_id") < 7, "odd"))
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    got = sorted(tuple(r) for r in divergence.audit(documents.withColumn("digest", F.lit(1)).withColumn("p", F.lit("x")), 2, 10).collect())
    assert got == brute_divergence(rows, 2, 10) and got
    none = documents.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    assert {r.value for r in divergence.audit(none, 10 ** 6).collect()} == {0}
    assert divergence.audit(documents.limit(0)).collect() == []


def test_only_digests_and_numbers_are_shuffled_before_the_text_join(shared):
    counts, _ = divergence._scan(shared.read.parquet(f"{SF01}/documents.parquet"), 64)
    plan = divergence._kept(counts, 10, "digest")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\b(low|high)#", plan) and plan.count("Exchange") == 1


# --- toxicity -----------------------------------------------------------------------------------------------

def test_label_model_recovers_rates_and_a_dependent_pair():
    rng = np.random.default_rng(3)
    n, prior = 60_000, 0.15
    on = np.array([0.6, 0.4, 0.7, 0.5, 0.3, 0.55])
    off = np.array([0.05, 0.02, 0.1, 0.01, 0.03, 0.05])
    y = rng.random(n) < prior
    fired = rng.random((n, 6)) < np.where(y[:, None], on, off)
    copy = np.where(rng.random(n) < 0.9, fired[:, 2], rng.random(n) < 0.1)  # follows voter 2 whatever the class
    clean = ~fired.any(axis=1)
    x = np.column_stack([fired, copy, clean]).astype(float)
    model = toxicity.fit_label_model(n, x.T @ x, prior, np.array([1] * 7 + [-1]))
    assert np.abs(model.on[[0, 1, 3, 4, 5]] - on[[0, 1, 3, 4, 5]]).max() < 0.08
    assert np.abs(model.off[[0, 1, 3, 4, 5]] - off[[0, 1, 3, 4, 5]]).max() < 0.03
    assert model.partner[6] == 2
    alone, both = model.posterior([2]), model.posterior([2, 6])
    assert abs(both - alone) < abs(model.posterior([2, 0]) - alone)  # an echo adds less than a second voter
    score = np.array([model.posterior(np.flatnonzero(r).tolist()) for r in x[:4000]])
    assert score[y[:4000]].mean() > 0.7 and score[~y[:4000]].mean() < 0.15


def test_held_out_rows_are_told_apart_and_their_labels_never_read(shared):
    docs, labels = (shared.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    from zlib import crc32
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    english = docs.where("lang = 'en'").join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    clean = [rows[r.doc_id].predicted for r in english if r.toxic == 0]
    bad = [rows[r.doc_id].predicted for r in english if r.toxic == 1]
    assert np.mean(clean) < 0.1 and np.mean(bad) > 0.7
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in rows.items())
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    again = {r.doc_id: r.score for r in toxicity.score_documents(other, labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in rows.items())


def test_toxicity_of_edge_rows_and_empty_tables(shared, documents):
    labels = shared.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    docs = documents.withColumn("score", F.lit("x")).withColumn("fired", F.lit(1)).withColumn("toxic", F.lit(9))
    for given in (labels, labels.limit(0)):
        rows = toxicity.score_documents(docs, given).collect()
        assert len(rows) == docs.count()
        assert all(r.score < 0.5 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
    insult = shared.createDataFrame([(70, "you are a stupid idiot, a moron and a loser"), (71, "they are kind people, all of them")], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(documents.select("doc_id", "text").unionByName(insult), labels.limit(0)).collect()}
    assert found[70] == 1 and found[71] == 0
