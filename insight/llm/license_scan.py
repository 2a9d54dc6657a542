"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into grams of up to ``GRAM`` words; of every few (up to ``WINDOW``) neighbouring grams the one of
least hash is kept, with its position, in an inverted index.  The grams of a document are looked up there; a stretch
of neighbouring diagonals (document minus template position) with enough hits of a template is a candidate, and a
sequence alignment within it counts the matched words and their span.  Gram, window and the hits asked for follow
from a template's length and the least coverage (``sizes``), so that no place of that coverage is missed whose words
lie on as many neighbouring diagonals as the template's band has: a short notice is looked up word by word.
The index holds the templates alone, whose words are checked against ``TEMPLATE_BYTES`` before they are sent to the
tasks; documents are scanned row by row without a shuffle.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case.  Defined results: null and
empty texts match nothing; templates without words (or null) are not searched; every row of
a repeated document reports its own matches; of overlapping places of a template the better one is reported.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, WIDEST = 3, 2, 4, 33
TEMPLATE_BYTES = 32 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: For ``bytes.translate``: A-Z to lower case, separators to spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Short notices by which licenses are stated (license, text).
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
#: Whole license texts, one file each, named by license.
TEXTS = Path(__file__).parent / "licenses"


def chain(spots: list[int]) -> list[int]:
    """Which of the hits, sorted by document place, make a longest run of increasing template spots (one hit a place:
    hits of one place come with falling spots)."""
    tails, ends, before = [], [], []
    for k, spot in enumerate(spots):
        at = bisect_left(tails, spot)
        if at == len(tails):
            tails.append(spot)
            ends.append(k)
        else:
            tails[at], ends[at] = spot, k
        before.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def sizes(n: int, min_coverage: float) -> tuple[int, int, int, int, int, int]:
    """Words that a match of a template of ``n`` words has, gram, window, least hits, diagonals of a candidate (its
    band: ``2 * BAND + 1``, and ``BAND`` more for every ``GRAM`` words, up to ``WIDEST`` or ``n // 32``) and
    their step.

    A match of ``least`` words lacks ``n - least``; where one is lacking or others stand between, a run of words in
    both texts ends.  Of ``runs`` at most, a run of r words keeps ``(r - gram + 1) // window`` grams or more.
    """
    least = max(1, math.ceil(min_coverage * n - 1e-9))
    width = min(2 * BAND + 1 + BAND * max(0, n // GRAM - 1), max(WIDEST, n // 32))
    step = max(1, (width - WIDEST) // 4)
    width += step - 1
    runs = 2 * (n - least) + width
    for gram, window in ((GRAM, WINDOW), (GRAM, 1), (2, 1)):
        hits = -(-(least - (gram + window - 2) * runs) // window)
        if hits >= max(1, least // 16):
            return least, gram, window, hits, width, step
    return least, 1, 1, least, width, step


class TemplateIndex:
    """Inverted index of winnowed template grams."""

    def __init__(self, templates: list[tuple[str, str]], min_coverage: float):
        self.names = [name for name, _ in templates]
        split = [words_of(t or "") for _, t in templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
        self.words = [np.array([self.ids[w] for w in ws], dtype=np.int64) for ws in split]
        self.sizes = [sizes(len(ws), min_coverage) for ws in self.words]
        posted: dict[int, list[tuple[int, int, int]]] = {}
        for t, ws in enumerate(self.words):
            _, gram, window, *_ = self.sizes[t]
            grams = self.grams(ws, gram)
            order = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            spots = {at + int(order[at:at + window].argmin()) for at in range(max(1, len(grams) - window + 1))} if len(grams) else set()
            posted.setdefault(gram, []).extend((int(grams[at]), t, at) for at in spots)
        #: By gram size: distinct grams, where the postings of each begin, and the postings' templates and positions.
        self.postings = {}
        for gram, rows in posted.items():
            table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
            keys, begins = np.unique(table[:, 0], return_index=True)
            self.postings[gram] = keys, np.append(begins, len(table)), table[:, 1], table[:, 2]

    @staticmethod
    def grams(ws: np.ndarray, gram: int) -> np.ndarray:
        """Exact codes of ``gram`` neighbouring word ids (below 2^20 each)."""
        if len(ws) < gram:
            return np.empty(0, dtype=np.int64)
        return sum(ws[k:len(ws) - gram + 1 + k] << (20 * (gram - 1 - k)) for k in range(gram))

    def candidates(self, ws: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray, np.ndarray]]:
        """(template, least and greatest diagonals of stretches with enough hits, places and spots of all its hits)."""
        for gram, (keys, begins, templates, spots) in self.postings.items():
            grams = self.grams(ws, gram)
            if not len(grams) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            places = np.flatnonzero(keys[at] == grams)
            # hits are of different template positions: few documents have as many at all
            met = np.zeros(len(keys), dtype=bool)
            met[at[places]] = True
            distinct = np.bincount(templates[np.repeat(met, np.diff(begins))], minlength=len(self.words))
            asked = [t for t, s in enumerate(self.sizes) if s[1] == gram and distinct[t] >= s[3]]
            if not asked:
                continue
            first, each = begins[at[places]], np.diff(begins)[at[places]]
            rows = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
            hit, where, spot = templates[rows], np.repeat(places, each), spots[rows]
            diagonals = where - spot
            for t in asked:
                *_, hits, width, step = self.sizes[t]
                mine = np.flatnonzero(hit == t)
                mine = mine[np.argsort(diagonals[mine], kind="stable")]
                edges = np.unique(diagonals[mine] // step * step)
                low, high = (np.searchsorted(diagonals[mine], e) for e in (edges, edges + width))
                # a stretch that ends at the same hit as the one before it lies inside that
                kept = np.flatnonzero((high - low >= hits) & (np.diff(high, prepend=0) > 0))
                mine_by_place = np.lexsort((-spot[mine], where[mine]))
                yield t, [(int(edges[k]), int(edges[k]) + width - 1) for k in kept
                          if len(np.unique(rows[mine[low[k]:high[k]]])) >= hits], where[mine][mine_by_place], spot[mine][mine_by_place]

    def align(self, ws: np.ndarray, t: int, low: int, high: int, begin: int, end: int) -> tuple[int, int, int]:
        """Most template words matched in order on these diagonals by the document's words from ``begin`` to before
        ``end``, in the shortest span that begins last; (matches, first, last document word)."""
        template = self.words[t]
        begin, end = max(begin, low), min(end, len(template) + high)
        if begin >= end:
            return 0, 0, 0
        one, places = 1 << 40, np.arange(end - begin) + (1 << 40)
        best, ws = np.zeros(end - begin + 1, dtype=np.int64), ws[begin:end]  # matches * one + first word, from 1 on
        for i, word in enumerate(template.tolist()):
            a, b = max(0, i + low - begin), min(len(ws), i + high + 1 - begin)
            if a < b:
                corner = best[a:b]
                longer = np.where(corner > 0, corner + one, places[a:b])
                best[a + 1:b + 1] = np.maximum.accumulate(np.maximum(best[a + 1:b + 1], np.where(ws[a:b] == word, longer, 0)))
        last = int(best.argmax())
        return int(best[last]) // one, begin + int(best[last]) % one, begin + last - 1

    def matches(self, ws: np.ndarray, t: int, stretches: list[tuple[int, int]], where: np.ndarray, spot: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Places of a template that don't overlap, the best first: (template, first, last word, matches).

        First the stretches; then, in what lies between the places found, the longest chain of hits in the order of
        both texts, however far its diagonals lie apart: words of any number may stand inside a match.
        """
        least, found, queue = self.sizes[t][0], [], []

        def ask(low: int, high: int, begin: int, end: int) -> None:
            if end - begin >= least:
                matched, first, last = self.align(ws, t, low, high, begin, end)
                if matched >= least:
                    heapq.heappush(queue, (-matched, last - first, first, last, low, high, begin, end))

        def drain() -> None:
            while queue:
                settle()

        def settle() -> None:
            less, _, first, last, low, high, begin, end = heapq.heappop(queue)
            near = found[max(0, bisect_left(found, (first,)) - 1):bisect_left(found, (last + 1,))]
            clash = next((f for f in near if f[1] >= first), None)
            if clash is None:
                insort(found, (first, last, -less))
                clash = (first, last)
            ask(low, high, begin, min(end, clash[0]))
            ask(low, high, max(begin, clash[1] + 1), end)
        for low, high in stretches:
            ask(low, high, 0, len(ws))
        drain()
        spans = [(0, len(ws))]
        while spans:  # every place found cuts the free span that it lies in, so this ends
            begin, end = spans.pop()
            inside = [f for f in found if begin <= f[0] < end]
            if inside:
                edges = [begin, *[x for first, last, _ in inside for x in (first, last + 1)], end]
                spans += list(zip(edges[::2], edges[1::2]))
                continue
            lo, hi = np.searchsorted(where, (begin, end))
            hits = chain(spot[lo:hi].tolist())
            if end - begin < least or len(hits) < self.sizes[t][3]:
                continue
            diagonals = (where[lo:hi] - spot[lo:hi])[hits]
            ask(int(diagonals.min()) - BAND, int(diagonals.max()) + BAND, begin, end)
            if queue:
                drain()
                spans.append((begin, end))
        whole = len(self.words[t])
        for k, (first, last, matched) in enumerate(found):  # a match may go on behind words that stand inside it
            begin, end = found[k - 1][1] + 1 if k else 0, found[k + 1][0] if k + 1 < len(found) else len(ws)
            lo, hi = np.searchsorted(where, (begin, end))
            hits = chain(spot[lo:hi].tolist())
            places, diagonals = where[lo:hi][hits], (where[lo:hi] - spot[lo:hi])[hits]
            if matched < whole and len(hits) and (places[0] < first or places[-1] > last):
                more, a, b = self.align(ws, t, int(diagonals.min()) - BAND, int(diagonals.max()) + BAND, begin, end)
                if more >= matched + max(GRAM, (whole - matched) / 2):
                    found[k] = a, b, more
        return [(t, first, last, matched) for first, last, matched in found]

    def scan(self, text: str) -> list[dict]:
        ids = self.ids
        ws = np.array([ids.get(w, 0) for w in words_of(text)], dtype=np.int64)
        kept = [place for t, *hits in self.candidates(ws) for place in self.matches(ws, t, *hits)]
        if not kept:
            return []
        raw = text.encode()
        spans = [m.span() for m in WORD.finditer(raw)]
        return [{"license": self.names[t], "template": t, "matched": matched, "coverage": matched / len(self.words[t]), "first_word": first,
                 "last_word": last, "start": len(raw[:spans[first][0]].decode()), "end": len(raw[:spans[last][1]].decode())}
                for t, first, last, matched in sorted(kept, key=lambda k: (k[1], k[0]))]


FOUND = ("array<struct<license:string,template:int,matched:long,coverage:double,first_word:long,last_word:long,start:long,end:long>>")


def scan_licenses(df: DataFrame, templates: DataFrame, min_coverage: float = 0.75, text: str = "text") -> DataFrame:
    """Adds ``licenses``: matches of ``templates`` (``license``, ``text``) with coverage and spans (words, characters)."""
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes exceed {TEMPLATE_BYTES}")
    rows = [(r[0], r[1]) for r in templates.select("license", "text").orderBy("license", "text").collect()]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = TemplateIndex(rows, min_coverage)
        for texts in batches:
            yield pd.Series([index.scan(t) if t else [] for t in texts], dtype=object)

    return df.withColumn("licenses", F.pandas_udf(run, FOUND)(F.col(text)))


def notices(spark: SparkSession) -> DataFrame:
    """The template table: short notices and whole license texts."""
    texts = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame(NOTICES + texts, "license string, text string")


def license_spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per match: document, license, coverage and span."""
    found = scan_licenses(docs.select("doc_id", "text"), templates).select("doc_id", F.explode("licenses").alias("m"))
    return found.select("doc_id", "m.license", "m.template", "m.matched", "m.coverage", "m.first_word", "m.last_word", "m.start", "m.end")
