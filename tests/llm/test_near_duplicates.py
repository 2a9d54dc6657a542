"""SimHash against all pairs, and benchmark hits against a scan."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from insight.llm import decontamination, simhash
from llm_fixtures import documents, shared  # noqa: F401


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(rows, bits=2):
    """rows: (id, fingerprint)"""
    low = {}
    for i, f in rows:
        low[f] = min(low.get(f, i), i)
    root = {f: f for f in low}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = list(low)
    for n, a in enumerate(fs):
        for b in fs[n + 1:]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for f in fs:
        least[find(f)] = min(least.get(find(f), low[f]), low[f])
    return {i: least[find(f)] for i, f in rows}


def test_fingerprints_of_edge_rows(documents):
    got = sorted((r.doc_id or -1, r.fingerprint) for r in simhash.near_duplicates(documents, 3).collect())
    assert got == sorted((r.doc_id or -1, f"{brute_fingerprint(r.text):016x}") for r in documents.collect())


def test_fixture_table_against_all_pairs(shared):
    docs = shared.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(rows)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs, 3).collect()} == {
        i: (f, want[i]) for i, f in rows}


@pytest.mark.parametrize("bits,longest", [(2, 32), (2, 3), (1, 3), (0, 3), (2, 1)])
def test_links_connect_all_close_fingerprints(shared, bits, longest, monkeypatch):
    """Chains, dense clusters and far points; short and long posting lists."""
    monkeypatch.setattr(simhash, "PAIR_LIST", longest)
    draw, fs = random.Random(longest), []
    for _ in range(12):
        f = draw.getrandbits(64)
        for _ in range(12):
            fs.append(f)
            for _ in range(draw.choice([1, 2, 2, 3])):
                f ^= 1 << draw.randrange(64)
        dense = draw.getrandbits(64)
        fs += [dense ^ (1 << b) for b in range(0, 64, 5)]
    fs = sorted(set(fs))
    signed = [f - (1 << 64) if f >> 63 else f for f in fs]
    nodes = shared.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.fp & (1 << 64) - 1: r.root for r in simhash.connected(simhash.links(nodes, bits)).collect()}
    ids = {f: i for i, f in enumerate(fs)}
    want = brute_components([(ids[f], f) for f in fs], bits)
    got = {}
    for f in fs:
        got.setdefault(roots.get(f, ("own", f)), []).append(ids[f])
    assert sorted(map(sorted, got.values())) == sorted(
        sorted(i for i in want if want[i] == c) for c in set(want.values()))


def test_a_hot_list_of_ten_thousand_fingerprints(shared):
    """All in one posting list: every link is kept, pairs stay linear, and each passes the tally and the distance."""
    nodes = shared.range(10_000).select((F.col("id") * 7 + (F.col("id") % 13) * 65_536).alias("fp")).distinct()
    close = simhash.links(nodes, 2).select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"))
    found = close.agg(F.count(F.lit(1)), F.max("bits"), F.min("bits")).first()
    assert found[0] < 33 * 6 * 10_000 and 1 <= found[2] <= found[1] <= 2
    fps = [r.fp for r in nodes.collect()]
    known, root = set(fps), {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    flips = [1 << i for i in range(22)]
    for f in fps:
        for x in [*flips, *(x | y for x in flips for y in flips if x < y)]:
            if f ^ x in known:
                root[find(f)] = find(f ^ x)
    least = {}
    for f in fps:
        least[find(f)] = min(least.get(find(f), f), f)
    got = {r.fp: r.root for r in simhash.connected(close.select("a", "b")).collect()}
    group = {}
    for f in fps:
        group.setdefault(got.get(f, f), set()).add(least[find(f)])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(least.values()))


def test_one_of_each(documents):
    left = simhash.one_of_each(documents, 3)
    assert left.columns == documents.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3, 5, 6, 7, 9]
    assert simhash.one_of_each(documents.limit(0), 3).collect() == []


def brute_hits(text, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win = w[i:i + width]
            for at in range(len(own) - len(win) + 1):
                if own[at:at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_hits_of_edge_rows(shared, documents):
    items = [(1, "cat SAT on"), (2, "a"), (10, "Two three four five six seven eight nine ten eleven twelve"), (3, ""), (4, None),
             (5, "été déjà"), (6, "Été DÉJÀ"), (7, "cat sat on"), (8, "never seen here"), (9, "b a b a b a b a b a b a"), (2, "a")]
    bench = shared.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 for r in decontamination.decontamination_digest(documents, bench).collect())
    assert got == sorted(((r.doc_id or -1), *brute_hits(r.text, items)) for r in documents.collect())
    clean = decontamination.without_matches(documents, bench)
    assert clean.columns == documents.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(
        r.doc_id or -1 for r in documents.collect() if not brute_hits(r.text, items)[-1])


def test_empty_sides(documents):
    nothing = documents.select("doc_id", "text").limit(0)
    bench = nothing.withColumnRenamed("doc_id", "item_id")
    assert {r.contaminated for r in decontamination.decontamination_digest(documents, bench).collect()} == {False}
    assert decontamination.decontamination_digest(nothing, bench).collect() == []


def test_proximity(shared):
    docs = shared.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha so beta gamma then delta"), (3, "delta gamma beta alpha x y z"),
                                   (4, "alpha")], "doc_id long, text string")
    bench = shared.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    near = {r.doc_id: [m.exact for m in r.matches] for r in decontamination.contamination(docs, bench, 10, 2).collect()}
    assert True in near[1] and near[2] and True not in near[2] and not near[3] and not near[4]


def test_proximity_against_brute_force(shared):
    draw, slop = random.Random(11), 1
    texts = ["a x b x c d", *(" ".join(draw.choices("abcdex", k=draw.randint(0, 9))) for _ in range(150))]
    items = ["a b c d", "b a d", "c e", "e d c b a"]
    for more in (["a"] * 200, ["b"] * 200):  # whichever word is the rarest
        rows = list(enumerate([*texts, " ".join(more)]))
        want = set()
        for i, text in rows:
            words = text.split()
            for k, item in enumerate(items):
                for start in range(-slop, len(words)):
                    if all(w in words[max(0, start + j - slop):max(0, start + j + slop + 1)] for j, w in enumerate(item.split())):
                        want.add((i, k, start))
        out = decontamination.contamination(shared.createDataFrame(rows, "doc_id long, text string"),
                                            shared.createDataFrame(list(enumerate(items)), "item_id long, text string"), 10, slop).collect()
        assert {(r.doc_id, int(item)) for r in out for item in r["items"]} == {(i, k) for i, k, _ in want}
        assert {(r.doc_id, m.length, m.start) for r in out for m in r.matches} == {(i, len(items[k].split()), s) for i, k, s in want}
        assert (0, 0) in {(i, k) for i, k, _ in want}
