"""Quality rules: an ordered decision list learned by sequential covering, emitted as Spark conditions.

``text_statistics`` measures a text with DataFrame functions alone, row by row and without a shuffle.
``learn`` fits the list on a bounded sample of labelled documents: it grows a conjunction of thresholds by
information gain on one part of the sample, prunes it on the other, keeps it if it rejects precisely
enough there, sets the documents it covers aside and goes on.  Each step is one aggregate over the stored
statistics of the sample; the driver sees only counts per feature and step of its grid.  ``verdict`` turns
the list into one CASE expression, evaluated in the scan of the documents to be judged.

Defined results: a null text has no words; counts are then zero and the base rule fails; shares over zero
are zero.  Labels: rows with a null id or label are left out, and so are ids labelled both ways.  Without
labels of both kinds the list is empty and the base rule decides.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.llm.columns import boxed, unboxed
from insight.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
#: Most labelled documents that the list is fitted on (drawn by a hash of the id).
MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS, MIN_SUPPORT, MIN_PRECISION = 6, 3, 5, 0.9


#: Columns that ``text_statistics`` adds.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all its columns, plus n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (which
    replace columns of these names)."""
    own = [f"in{k}_" for k in range(len(df.columns))]
    body = F.coalesce(F.col("_body"), F.lit(""))
    out = boxed(df, _body=text).select(*own, F.array_remove(F.split(body, SPACE), "").alias("_words"),
                    F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
                    F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    at = F.col("_words")
    hashed = F.transform(F.slice(at, 1, F.greatest(F.size(at) - 2, F.lit(0))), lambda w, i: F.struct(
        F.xxhash64(w, F.get(at, i + 1), F.get(at, i + 2)).alias("h"), i.alias("p")))
    out = out.select(*own, "n_symbols", "_words", F.sort_array(hashed).alias("_windows"),
                     F.size(at).cast("long").alias("n_words"), F.length(F.array_join(at, "")).cast("long").alias("word_chars"),
                     F.size("_lines").cast("long").alias("n_lines"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))

    def same(x: Column, y: Column) -> Column:
        """Equal hashes settle most; equal words confirm."""
        return F.coalesce((x["h"] == y["h"]) & reduce(lambda a, b: a & b, [
            F.get(at, x["p"] + k) == F.get(at, y["p"] + k) for k in range(3)]), F.lit(False))

    windows = F.col("_windows")
    twice = F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | (F.when(i > 0, same(x, F.get(windows, i - 1))).otherwise(False)))
    out = out.select(*[c for c in out.columns if c not in ("_words", "_windows", "_lines")],
                     F.sort_array(F.transform(twice, lambda x: x["p"])).alias("_twice"))
    spots = F.col("_twice")
    steps = F.transform(spots, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1) - p, F.lit(3))))
    repeats = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words")
    # a generated row: filters on the statistics stay above it instead of evaluating them once more below
    out = out.select(*own, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats))))
    return unboxed(out, df.columns, *STATISTICS)


def base_failed() -> Column:
    """The fixed rule before the learned ones: too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str, steps: int) -> Column:
    """Grid step of a / b; zero if b is."""
    return F.when(F.col(b) > 0, F.floor(F.col(a) * F.lit(steps) / F.col(b))).otherwise(F.lit(0)).cast("long")


def features() -> dict[str, Column]:
    """Grid steps of the features that conditions compare: pure functions of a row's statistics."""
    return {
        "words_log2_x4": F.floor(F.log2(F.col("n_words") + F.lit(1)) * 4).cast("long"),
        "symbols_per_200_word_chars": _share("n_symbols", "word_chars", 200),
        "dup_lines_per_50_lines": _share("n_dup_lines", "n_lines", 50),
        "repeat_words_per_50_words": _share("n_repeat_words", "n_words", 50),
        "word_chars_per_word_x4": _share("word_chars", "n_words", 4),
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (or below) a step of its grid."""

    feature: str
    at_least: bool
    step: int

    def column(self, steps: dict[str, Column]) -> Column:
        f = steps[self.feature]
        return f >= F.lit(self.step) if self.at_least else f < F.lit(self.step)


Rule = tuple[Condition, ...]


def _holds(rule: Rule, steps: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.column(steps) for c in rule], F.lit(True))


def _best_condition(counts: list, p: int, n: int) -> tuple[Condition | None, int, int]:
    """The threshold of most information gain; ``counts`` holds (feature, step, bad, good)."""
    best, gain = (None, 0, 0), 1e-9
    base = math.log2(p / (p + n))
    by_feature: dict[str, list] = {}
    for f, step, bad, good in counts:
        by_feature.setdefault(f, []).append((step, bad, good))
    for f in sorted(by_feature):
        below_p = below_n = 0
        for step, bad, good in sorted(by_feature[f]):
            for at_least, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                if cp >= MIN_SUPPORT and cp + cn < p + n:
                    g = cp * (math.log2(cp / (cp + cn)) - base)
                    if g > gain:
                        best, gain = (Condition(f, at_least, int(step)), cp, cn), g
            below_p, below_n = below_p + bad, below_n + good
    return best


def learn(frame: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
          min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Ordered rules that reject, from a stored ``frame`` of feature steps, ``bad`` (boolean) and ``grow`` (boolean)."""
    names = [c for c in frame.columns if c not in ("bad", "grow")]
    steps = {f: F.col(f) for f in names}
    bad, good = F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")
    rules: list[Rule] = []
    left = frame
    while len(rules) < max_rules:
        rule: Rule = ()
        p, n = left.where("grow").agg(bad, good).first()
        while p and n and len(rule) < max_conditions:
            seen = left.where(F.col("grow") & _holds(rule, steps))
            cells = (seen.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("s")) for f in names])).alias("c"))
                     .groupBy("c.f", "c.s").agg(bad, good).collect())
            condition, cp, cn = _best_condition(cells, p, n)
            if condition is None:
                break
            rule, p, n = (*rule, condition), cp, cn
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        tallies = left.where(~F.col("grow")).agg(*[F.count_if(_holds(r, steps) & kind)
                                                   for r in prefixes for kind in (F.col("bad"), ~F.col("bad"))]).first()
        worth = [((tp - fp) / (tp + fp) if tp + fp else -1.0, -len(r), r, tp, fp)
                 for r, tp, fp in zip(prefixes, tallies[::2], tallies[1::2])]
        _, _, rule, tp, fp = max(worth, key=lambda w: w[:2])
        if tp < MIN_SUPPORT or tp < min_precision * (tp + fp):
            break
        rules.append(rule)
        left = left.where(~_holds(rule, steps))
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from ``labels`` (``doc_id``, ``quality`` 0 or 1) and the documents they name."""
    clear = (labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi"))
    drawn = clear.select("doc_id", (F.col("lo") == 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    named = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most max_labelled rows of 9 bytes
    told = text_statistics(named).where(~base_failed())
    grow = F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0
    return learn(stored(told.select(*[c.alias(f) for f, c in features().items()], "bad", grow.alias("grow")), "quality-sample"))


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false for what the first rule that holds rejects, else true."""
    steps, out = features(), F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(_holds(rule, steps), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``, which replace columns of these names."""
    told = text_statistics(docs).withColumn("base_failed", base_failed())
    return told.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def only_kept(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the list keep, with all their columns as they are."""
    return unboxed(judge(boxed(docs, text=text), rules).where("kept"), docs.columns)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and decision of every document by the list learned from ``labels``."""
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
