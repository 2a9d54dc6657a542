"""Chat trees, shards, quality rules, fixity, licenses and language-model scores on small tables."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from insight.llm import chat_trees, fixity, license_scan, lm_scoring, quality_rules, sharding
from llm_fixtures import documents, shared  # noqa: F401

MESSAGES = "tree string, node long, parent long, role string, text string, score double"


def test_branches_are_ranked_and_complete(shared):
    draw, rows = random.Random(3), []
    for t in range(6):
        for n in range(1, 40):
            rows.append((f"t{t}", n, draw.choice([None, *range(1, n)]) if n > 1 else None, "user", str(n), float(draw.randint(0, 3))))
    rows += [("chain", n, n - 1 if n else None, "user", str(n), None) for n in range(70)]
    rows += [("loop", 1, 2, "a", "x", 1.0), ("loop", 2, 1, "a", "x", 1.0), ("lost", 5, 99, "a", "x", 1.0), ("self", 3, 3, "a", "x", 1.0)]
    got = defaultdict(dict)
    for r in chat_trees.branches(shared.createDataFrame(rows + rows[:5], MESSAGES)).collect():
        got[r.tree, r.leaf, r["rank"], r.total][r.place] = r.node
    by = {(t, n): (p if p != n else None, s or 0.0) for t, n, p, _, _, s in rows}
    want, parents = defaultdict(list), {(t, p) for (t, n), (p, _) in by.items() if p is not None}
    for t, n in by:
        if (t, n) not in parents and t != "loop":
            path, at = [], n
            while at is not None and (t, at) in by:
                path.append(at)
                at = by[t, at][0]
            want[t].append((-sum(by[t, x][1] for x in path), n, path[::-1]))
    assert {(t, leaf, rank, total): [steps[i] for i in range(len(steps))] for (t, leaf, rank, total), steps in got.items()} == {
        (t, n, k, -s): path for t, ps in want.items() for k, (s, n, path) in enumerate(sorted(ps), 1)}
    best = chat_trees.format_paths(shared.createDataFrame(rows, MESSAGES), top=1).groupBy("tree").count().collect()
    assert {r["count"] for r in best} == {1} and len(best) == len(want)


def test_control_strings_are_reversible(shared):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "\\<|", "<\\|", "\\\\|", "", None, "a\\n b", "<<||>>", "é\n"]
    rows = [("t", i, i - 1 if i else None, r, t, 0.0) for i, (r, t) in enumerate(
        (r, t) for t in texts for r in ("assistant", "us\ner", "\\n", None))]
    out = chat_trees.read_back(chat_trees.format_paths(shared.createDataFrame(rows, MESSAGES))).collect()
    assert len(out) == 1 and out[0].formatted.count("<|im_start|>") == len(rows)
    assert [(s.role, s.text) for s in out[0].said] == [(r[3] or "", r[4] or "") for r in rows]
    assert out[0].learnt == "".join(t or "" for _, _, _, r, t, _ in rows if r == "assistant")
    for turn, r in zip(out[0].turns, rows):
        assert turn.loss_chars == (len((r[4] or "").replace("\\", "\\\\").replace("<|", "<\\|")) if r[3] == "assistant" else 0)


def test_conversations_with_nulls_and_ties(shared):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, "user", "x"), (2, 5, None, ""), (2, 5, None, "")]
    got = {r.conv_id: r.n_turns for r in chat_trees.chat_digest(
        shared.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: 3, None: 1, 2: 2}
    assert chat_trees.chat_digest(shared.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_shards_match_the_mixture(shared, documents):
    draw = random.Random(1)
    rows = [(i, draw.choice(["hot"] * 5 + ["b", "c", None])) for i in range(5000)] + [(7, "b")] * 5
    df = shared.createDataFrame([(i, s, "x", 1) for i, s in rows], "doc_id long, source string, key string, rank int")
    got = sharding.interleave(df, 7, buckets=16).collect()
    counts, n = Counter(r.shard for r in got), len(rows)
    assert len(got) == n and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    for source, total in Counter(s for _, s in rows).items():
        for shard in range(7):
            mine = sum(r.source == source and r.shard == shard for r in got)
            assert abs(mine - total * counts[shard] / n) < 2
    assert sorted(map(tuple, sharding.interleave(df, 7, buckets=16).collect()), key=str) == sorted(map(tuple, got), key=str)
    digest = sharding.shard_digest(documents, 40).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in digest) == sorted(
        (r.doc_id or -1, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert sharding.shard_digest(documents.limit(0)).collect() == []


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_shards_by_their_definition(shared, buckets):
    """Seeded order in each source, fractional ranks, one order of all, equal runs."""
    df = shared.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"))
    own = df.select("*", F.xxhash64(F.lit(42), "doc_id").alias("h"), F.xxhash64("doc_id", "source").alias("e"))
    rows = own.withColumn("b", F.pmod(F.shiftright(F.xxhash64("h", "e"), 40), F.lit(buckets or 30))).collect()
    order = []
    for source in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (r.b, r.h, r.doc_id, r.e))
        order += [((2 * k + 1) / (2 * len(mine)), "s" + source, r.h, r.doc_id) for k, r in enumerate(mine)]
    shard_of = [p * 7 // len(order) for p in range(len(order))]
    want = {o[3]: (s, p - shard_of.index(s)) for p, (o, s) in enumerate(zip(sorted(order), shard_of))}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, 7, buckets=buckets).collect()} == want


def test_shard_files_are_in_slot_order(shared, documents):
    path = sharding.write_shards(documents, 3)
    back = shared.read.parquet(path)
    assert back.count() == documents.count() and set(documents.columns) < set(back.columns)


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_statistics(shared, documents):
    docs = documents.unionByName(shared.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("key", F.lit("")))
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                 for r in quality_rules.text_statistics(docs).collect())
    assert got == sorted((r.doc_id or -1, *brute_statistics(r.text)) for r in docs.collect())


def test_learned_list_on_held_out_labels(shared):
    docs = shared.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = shared.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rules = quality_rules.fit(docs, train)
    assert rules
    judged = quality_rules.judge(docs.join(held, "doc_id"), rules).where("not base_failed").groupBy("quality", "kept").count().collect()
    n = defaultdict(int, {(r.quality, r.kept): r["count"] for r in judged})
    assert n[1, True] >= 0.99 * (n[1, True] + n[1, False])
    assert n[0, False] >= 0.9 * (n[0, False] + n[1, False])


def test_covering_finds_planted_conjunction(shared):
    draw = random.Random(2)
    rows = [(draw.randint(0, 20), draw.randint(0, 20), draw.random() < 0.66) for _ in range(3000)]
    frame = shared.createDataFrame([(a, b, a >= 12 and b < 7, g) for a, b, g in rows], "a long, b long, bad boolean, grow boolean")
    rules = quality_rules.learn(frame)
    assert {(c.feature, c.at_least, c.step) for c in rules[0]} == {("a", True, 12), ("b", False, 7)}
    assert quality_rules.learn(frame.limit(0)) == [] and quality_rules.learn(frame.where("not bad")) == []


def test_judging_without_labels(documents, shared):
    labels = shared.createDataFrame([(None, 1, 0), (1, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_digest(documents, labels).collect()
    assert len(got) == documents.count() and all(r.base_failed and not r.kept for r in got)


def test_audit_finds_every_difference(shared):
    draw = random.Random(4)
    ours = [(f, o * 700, f"{f}-{o}") for f in range(3) for o in range(900)] + [(9, 0, "only"), (1, 0, "twin")]
    theirs = {(f, o): s for f, o, s in ours if s != "twin"}
    want = {(1, 0): "corrupt"}
    for f, o, _ in draw.sample(ours[:2700], 40):
        if (f, o) == (1, 0):
            continue
        kind = draw.choice(["corrupt", "missing", "extra"])
        if kind == "missing":
            theirs.pop((f, o), None)
            want[f, o] = kind
        elif kind == "corrupt":
            theirs[f, o] = "bad"
            want[f, o] = kind
        else:
            theirs[f, o + 13] = "stray"
            want[f, o + 13] = kind
    del theirs[9, 0]
    want[9, 0] = "missing"
    a = shared.createDataFrame(ours, "file long, offset long, sha string")
    b = shared.createDataFrame([(f, o, s) for (f, o), s in theirs.items()], "file long, offset long, sha string")
    assert {(r.file, r.offset): r.status for r in fixity.audit(a, b).collect()} == want
    assert fixity.audit(a, a).collect() == [] and fixity.audit(a.limit(0), b.limit(0)).collect() == []
    assert len(fixity.audit(a.limit(0), b).collect()) == len(theirs)


def test_pages_with_nulls(shared):
    pages = shared.createDataFrame([(7, None, None), (11, "u", ""), (19, "u", "x" * 70000), (None, "u", "y"), (19, "u", "x" * 70000)],
                                   "page_id long, url string, html string")
    placed = fixity.place_records(pages, 1 << 20).collect()
    assert len(placed) == 5 and len({(r.file, r.offset) for r in placed}) == 5
    assert {r.status for r in fixity.fixity_audit(pages).collect()} == {"corrupt", "missing", "extra"}


def test_replicas_are_hashed_from_their_bytes(shared, monkeypatch):
    rows = [(i, f"u{i}", f"page {i} " * (i % 50)) for i in range(400)]
    pages = shared.createDataFrame(rows, "page_id long, url string, html string")
    replicas, write = {}, fixity.written

    def broken(records, name):
        """As a disk that flips a bit of page 250 in the second replica."""
        if name == "replica":
            bad = F.regexp_replace("record", "(?s)(page:250>.*)g", "$1f")
            records = records.withColumn("record", bad)
        replicas[name] = write(records, name)
        return replicas[name]

    monkeypatch.setattr(fixity, "written", broken)
    got = {(r.page_id, r.status) for r in fixity.fixity_audit(pages, 4096).collect()}
    assert got == ({(i, "missing" if i % 211 == 11 else "corrupt") for i in range(400) if i % 211 == 11 or i % 101 == 7 or i == 250}
                   | {(i, "extra") for i in range(400) if i % 307 == 19})
    for r in replicas["records"].collect():
        assert len(r.record.encode()) == r.n_bytes and r.record.startswith("WARC/1.0\r\n")
    assert replicas["replica"].where("record like 'wARC%'").count() == 4


def test_license_spans(shared):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"Été hello.\n{notice} and more"), (2, None), (3, ""), (4, "licensed UNDER the apache license version 2 0"),
            (5, "Released under   the MIT\nLicense."), (6, "the license version of the work under the MIT"), (7, notice + " x " * 2000 + notice),
            (8, "Licensed under the Apache Public License, Version 2.0."), (4, "licensed UNDER the apache license version 2 0")]
    docs = shared.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.license_spans(docs, license_scan.notices(shared)).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {(1, "Apache-2.0"): 1, (4, "Apache-2.0"): 2, (5, "MIT"): 1, (7, "Apache-2.0"): 2, (8, "Apache-2.0"): 1}
    one = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][one.start:one.end] == notice[:-1] and one.coverage == 1.0


def test_license_table_against_plain_search(shared):
    docs = shared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Counter(r.doc_id for r in license_scan.license_spans(docs, license_scan.notices(shared)).where("coverage = 1").collect())
    flat = [(n, b" " + b" ".join(license_scan.words_of(t)) + b" ") for n, t in license_scan.NOTICES]
    want = Counter()
    for r in docs.collect():
        hay = b"  ".join([b"", *license_scan.words_of(r.text), b""]).replace(b"  ", b" ")
        for _, needle in flat:
            if hay.count(needle):
                want[r.doc_id] += hay.count(needle)
    assert got == +want and want


def test_license_lines_of_the_documents(shared):
    docs = shared.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stated = re.compile(r"(?i)licen[cs]e|rights reserved|copyright|permission is|public domain")
    want = {(r.doc_id, line) for r in docs.collect() for line in (r.text or "").split("\n") if stated.search(line)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = license_scan.license_spans(docs, license_scan.notices(shared)).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append(texts[r.doc_id][r.start:r.end])
    assert len({line for _, line in want}) == 5
    assert not [(i, line) for i, line in want if not any(s in line and len(s) >= len(line) - 1 for s in spans[i])]


def plain_alignment(words, template):
    """Words of ``template`` found in order in ``words``."""
    row = [0] * (len(words) + 1)
    for t in template:
        last = 0
        for j, w in enumerate(words, 1):
            last, row[j] = row[j], last + 1 if w == t else max(row[j], row[j - 1])
    return row[-1]


def test_edited_notices_against_plain_alignment():
    draw, missed, places = random.Random(8), [], 0
    index = license_scan.TemplateIndex(license_scan.NOTICES, 0.75)
    split = [license_scan.words_of(t) for _, t in license_scan.NOTICES]
    for _ in range(150):
        doc = [draw.choice([b"the", b"of", b"license", b"under", b"x"]) for _ in range(draw.randint(0, 30))]
        for t in draw.choices(range(len(split)), k=2):
            kept = [[w, draw.choice([w, w, b"x"]), b"y"][min(2, draw.randint(0, 14) // 6)] for w in split[t]]
            doc += [x for w in kept for x in ([w, b"z"] if draw.random() < 0.05 else [w])] + [b"end"] * draw.randint(0, 9)
        found = index.scan(b" ".join(doc).decode())
        for r in found:
            assert plain_alignment(doc[r["first_word"]:r["last_word"] + 1], split[r["template"]]) == r["matched"]
        for t, template in enumerate(split):
            for begin in range(len(doc)):
                span = doc[begin:begin + len(template)]
                if plain_alignment(span, template) >= 0.75 * len(template):
                    places += 1
                    if not any(r["template"] == t and r["first_word"] < begin + len(span) and r["last_word"] >= begin for r in found):
                        missed.append((t, span))
    assert places > 100 and not missed
    for text in ("Released under MIT License", "Released under a MIT License", "licensed under an apache license release 2 0"):
        assert [r["coverage"] >= 0.75 for r in index.scan(text)] == [True]
    assert len(index.scan("Released under the MIT License. " * 3)) == 3


def test_whole_license_texts(shared):
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(license_scan.TEXTS.glob("*.txt"))]
    docs = shared.createDataFrame([(i, f"Some file.\n\n{t.upper()}\nEnd of it.") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = license_scan.license_spans(docs, license_scan.notices(shared)).where("coverage = 1 and matched > 150").collect()
    assert len(texts) >= 9 and {(i, name) for i, (name, _) in enumerate(texts)} <= {(r.doc_id, r.license) for r in got}


def brute_scores(rows, order=2, least=2):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts = Counter(tuple(w[k:k + n]) for _, w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def micro(gram):
        if len(gram) == 1:
            return round(math.log(counts[gram] / total) * 1e6)
        if counts[gram] >= least:
            return round(math.log(counts[gram] / counts[gram[:-1]]) * 1e6)
        return round(math.log(0.4) * 1e6) + micro(gram[1:])

    return sorted((i or -1, len(w), sum(micro(tuple(w[max(0, k - order + 1):k + 1])) for k in range(len(w)))) for i, w in words)


@pytest.mark.parametrize("slice_bytes", [300, 4 << 20])
def test_scores(shared, documents, monkeypatch, slice_bytes):
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", slice_bytes)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for order in (1, 2, 3) if slice_bytes == 300 else (4,):
        got = sorted((r.doc_id or -1, r.n_words, r.log_micro) for r in lm_scoring.score(documents, order).collect())
        assert got == brute_scores(rows, order)
    assert lm_scoring.score_documents(documents.limit(0)).collect() == []


def test_scores_of_copies_and_any_ids(shared):
    texts = ["a b c a b c a b d"] * 300 + ["a b c", "a", "", None, "x y", "ha " * 5000] + ["ok"] * 200
    rows = [(f"id{i}" if i % 9 else None, t, 1, 2) for i, t in enumerate(texts)]
    docs = shared.createDataFrame(rows, "doc_id string, text string, h int, k1 int").repartition(5)
    got = Counter((r.doc_id, r.n_words, r.log_micro) for r in lm_scoring.score(docs).collect())
    want = brute_scores([(k, t) for k, t in enumerate(texts)], 3)
    by = {max(k, 0): (n, m) for k, n, m in want}
    assert got == Counter((rows[k][0], *by[k]) for k in range(len(texts)))
    # copies leave a task once: the rows that are exploded grow with the different texts of a task only
    one = shared.createDataFrame(rows[:300], "doc_id string, text string, h int, k1 int").coalesce(1).selectExpr("doc_id", "text", "1L AS k1", "2L AS k2")
    assert lm_scoring._exploded(one, 3).agg({"n": "sum"}).first()[0] == 9


def test_scores_by_passes(shared, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PASS_WORDS", 100)
    texts = ["a b c a b c a b d a a a", "b c a b c", "a", "", None, "x y", "the a the b the c", "the a the b the c"] * 20
    docs = shared.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(3)
    for order in (1, 2, 3, 4):
        got = sorted((r.doc_id, r.n_words, r.log_micro) for r in lm_scoring.score(docs, order).collect())
        assert got == brute_scores(list(enumerate(texts, 1)), order)
    # every place is in one pass, with all that its context and its last two words occur in
    slices = lm_scoring._numbered(docs.selectExpr("text", "xxhash64(text) AS k1", "xxhash64(1, text) AS k2").where("text <> ''")).cache()
    rows = [Counter(map(tuple, lm_scoring._exploded(slices, 3, part, 4).collect())) for part in range(4)]
    assert sum(rows, Counter()) == Counter(map(tuple, lm_scoring._exploded(slices, 3).collect())) and sum(map(bool, rows)) > 1
    for at in (3, 4):
        assert sum(len({row[at] for row in own}) for own in rows) == len({row[at] for own in rows for row in own})


def test_scoring_leaves_no_rows_in_shuffle_files(shared):
    def left():
        files = shared._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(k) for k in range(files.size())]
        return {f.getName(): f.length() for f in files if re.fullmatch(r"shuffle_.*\.data", f.getName())}

    docs = shared.range(5000).selectExpr("id AS doc_id", "concat_ws(' ', id % 7, id % 5, id, 'a b c', id % 3) AS text")
    before = left()
    scores = lm_scoring.score(docs)
    for _ in range(40):
        grown = sum(size for name, size in left().items() if name not in before)
        if grown < 4000:
            break
        time.sleep(0.25)
    # the sums of the words, no row of a word or an n-gram
    assert grown < 4000 and scores.count() == 5000
