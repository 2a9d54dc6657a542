"""License texts with words put in and taken out, against a plain alignment over all positions."""

import random

import numpy as np
import pytest

from insight.llm import license_scan
from llm_fixtures import documents, shared  # noqa: F401

TEMPLATES = license_scan.NOTICES + [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(license_scan.TEXTS.glob("*.txt"))]
INDEX = license_scan.TemplateIndex(TEMPLATES, 0.75)


def plain(words, template):
    """Length of the longest common subsequence."""
    best = np.zeros(len(words) + 1, dtype=np.int64)
    own = np.array(words, dtype=object)
    for w in template:
        hit = np.append(0, np.where(own == w, best[:-1] + 1, 0))
        best = np.maximum.accumulate(np.maximum(best, hit))
    return int(best[-1])


WHOLE = [k for k, (_, text) in enumerate(TEMPLATES) if len(license_scan.words_of(text)) > 100]


@pytest.mark.parametrize("k", WHOLE)
@pytest.mark.parametrize("inserted,places", [(10, 1), (60, 1), (400, 1), (1000, 1), (200, 3)])
def test_inserted_words_lose_no_match(k, inserted, places):
    rng = random.Random(k * 7 + inserted)
    words = TEMPLATES[k][1].split()
    cuts = sorted(rng.sample(range(len(words) // 5, len(words) - len(words) // 5), places))
    parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
    text = "some words before "
    for n, part in enumerate(parts):
        text += " ".join(part) + " " + (" ".join(f"zq{rng.randrange(10 ** 6)}" for _ in range(inserted)) + " " if n < len(parts) - 1 else "and after")
    found = [m for m in INDEX.scan(text) if m["template"] == k]
    template = license_scan.words_of(TEMPLATES[k][1])
    assert len(found) == 1 and found[0]["matched"] == plain(license_scan.words_of(text), template) == len(template)


@pytest.mark.parametrize("k", WHOLE)
def test_removed_words_keep_their_coverage(k):
    words = TEMPLATES[k][1].split()
    at, less = len(words) // 3, len(words) // 6
    text = " ".join(words[:at] + words[at + less:])
    found = [m for m in INDEX.scan(text) if m["template"] == k]
    template = license_scan.words_of(TEMPLATES[k][1])
    assert len(found) == 1 and found[0]["matched"] == plain(license_scan.words_of(text), template) >= 0.75 * len(template)


def test_two_copies_one_of_them_torn_apart():
    k = WHOLE[0]
    words = TEMPLATES[k][1].split()
    middle = len(words) // 2
    text = " ".join([*words, *["zq"] * 300, *words[:middle], *["zr"] * 700, *words[middle:]])
    found = [m for m in INDEX.scan(text) if m["template"] == k]
    n = len(license_scan.words_of(TEMPLATES[k][1]))
    assert [m["matched"] for m in found] == [n, n] and found[0]["last_word"] == n - 1 and found[1]["first_word"] == n + 300


def test_unrelated_words_alone_match_nothing():
    rng = random.Random(2)
    vocabulary = [w.decode() for w in license_scan.words_of(TEMPLATES[WHOLE[-1]][1])]
    assert not [m for m in INDEX.scan(" ".join(rng.choices(vocabulary, k=3000))) if m["template"] in WHOLE]


def test_empty_table_and_a_column_of_the_output_name(shared, documents):
    templates = license_scan.notices(shared)
    assert license_scan.scan_licenses(documents.limit(0), templates).collect() == []
    rows = license_scan.scan_licenses(documents.withColumn("licenses", documents.key), templates).collect()
    assert len(rows) == documents.count() and all(r.licenses == [] for r in rows)
