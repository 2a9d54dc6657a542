"""Toxicity by weak supervision.

Voters look at a text each in their own way and fire or keep silent: lexicons (words mined from labelled
training rows, dealt into several lists, and a fixed list of insults), patterns (beginnings of words mined
the same way, insults addressed to someone, shouting, masked letters) and one voter for texts that show
nothing of all this.  How often they fire and fire together over **all** documents is a table of fixed size;
from it alone, without labels, a generative model of one hidden class estimates how often each voter fires on
toxic and on clean texts, and which voters depend on each other beyond the class:

* given the class, independent voters have covariance ``pi (1 - pi) d_i d_j`` with ``d`` the difference of
  their two rates, so ``d`` is the best rank-one fit of the correlations off the diagonal;
* pairs that stay far from the fit are correlated; they leave the fit, which is repeated, and in the
  posterior a voter whose partner has fired already counts by its rate given that partner.

The posterior of a text is the prior's log-odds plus the log-ratio of every voter that fires.  A linear
(logistic) classifier over voters, mined terms and how much of the text they make up is then trained on the
posteriors of labelled training rows, never on their labels, and scores every document.  The label model's own
log-ratios are the centre of its ridge, so without training rows it is the label model.

Labels are read only of rows whose crc32(doc_id as text) is not divisible by five: for mining (at most
``MAX_LABELLED`` rows, those of the smallest id hash) and for the share of toxic rows.

Defined results: null and empty texts fire no voter and score low; a null id counts as empty text for the
hold-out rule, hence is held out; repeated rows are scored each; without labels the fixed voters and a prior
of ``PRIOR`` (which weighs as 20 rows) remain; an empty table gives no row; only ``doc_id`` and ``text`` are read, whatever else the
table holds; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insight.llm.storage import stored

#: Labelled training rows that terms are mined from and the classifier is fitted on, at most.
MAX_LABELLED = 15_000
#: Tasks that the training rows are dealt to.
PARTS = 24
#: Mined terms: words and beginnings of words.
MOST_WORDS, MOST_PREFIXES = 256, 64
#: Lists that mined words and beginnings are dealt into; each is one voter.
WORD_VOTERS, PREFIX_VOTERS = 10, 5
#: A mined term occurs in at least so many different toxic texts, with this precision and this many standard errors of its
#: log-odds; texts that share their least three-word hash count as one.  A beginning stands for several words.
LEAST_TEXTS, LEAST_PRECISION, LEAST_Z, LEAST_VARIETY = 6, 0.9, 2.9, 3
PREFIXES = (4, 5, 6)
PRIOR = 0.1
#: Residual correlation from which two voters are taken as dependent, and the largest ratio of a voter's two rates.
DEPENDENT, MOST_RATIO = 0.15, 200.0
RIDGE = 0.5

# Insults of the fixed lexicon
INSULTS = ("clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic",
           "scum", "stupid", "trash", "worthless")

_FOLD = bytes(0x20 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
_PATTERNS = (
    re.compile(r"\b(?:you|u|your|you're)\b[^.!?\n]{0,20}\b(?:" + "|".join(INSULTS) + r")s?\b", re.I),
    re.compile(r"(?:\b[A-Z]{4,}\b\W+){3}"),
    re.compile(r"\b[A-Za-z]+[*@#$]+[A-Za-z]+\b"),
)
INSULT_VOTER = WORD_VOTERS + PREFIX_VOTERS
PATTERN_VOTER = INSULT_VOTER + 1
CLEAN_VOTER = PATTERN_VOTER + len(_PATTERNS)
VOTERS = CLEAN_VOTER + 1
#: Rates of fixed voters that fire on under five texts of the corpus (the others then say nothing).
RATES = {INSULT_VOTER: (0.5, 0.01), PATTERN_VOTER: (0.2, 0.01)}
#: Classifier features behind voters and terms: two hits and more, three and more, share of hits among the words.
EXTRA = 3


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def beginnings(word: bytes) -> list[str]:
    chars = word.decode()
    return [chars[:k] for k in PREFIXES if len(chars) > k]


# --- mining -------------------------------------------------------------------------------------------------

def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """``text``, ``toxic`` of the labelled rows outside the hold-out, one per text, the smallest id hashes first."""
    given = (labels.select(F.col(id_col).alias("_i"), F.col(label).cast("int").alias("toxic")).where("toxic is not null").groupBy("_i")
             .agg(F.max("toxic").alias("toxic")).where(~held_out("_i")).orderBy(F.xxhash64(F.col("_i").cast("string")), "_i").limit(MAX_LABELLED))
    rows = df.select(F.col(id_col).alias("_i"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(given), "_i")
    one = rows.groupBy(F.sha2("text", 256).alias("_t")).agg(F.min("_i").alias("_i")).orderBy("_i").limit(MAX_LABELLED)
    return rows.join(F.broadcast(one.select("_i")), "_i", "left_semi").dropDuplicates(["_i"]).select("text", "toxic").repartition(PARTS)


def held_out(id_col: str):
    """Whether a row belongs to the fold whose labels are never read."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def signature(words: list[bytes]) -> int:
    """Least hash of a text's three-word runs: near copies share it, other texts hardly ever do."""
    runs = {b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    return min(map(xxhash.xxh64_intdigest, runs)) - (1 << 63)


def mined_terms(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words, and beginnings of words, that tell toxic rows from clean ones; best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                listed = words_of(text)
                words = set(listed)
                pairs = [(0, w.decode(), w) for w in words] + [(1, p, w) for w in words for p in beginnings(w)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in pairs], pa.int32()), pa.array([t for _, t, _ in pairs], pa.string()),
                     pa.array([signature(listed)] * len(pairs), pa.int64()), pa.array([toxic] * len(pairs), pa.int32()),
                     pa.array([toxic << xxhash.xxh64_intdigest(w) % 63 for _, _, w in pairs], pa.int64())], names=["kind", "term", "sign", "toxic", "variety"])

    sizes = rows.groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in sizes}
    t, n = total.get(1, 0), total.get(0, 0)
    seen = (rows.mapInArrow(run, "kind int, term string, sign long, toxic int, variety long")
            .groupBy("kind", "term", "sign").agg(F.max("toxic").alias("toxic"), F.bit_or("variety").alias("variety"))
            .groupBy("kind", "term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"), F.bit_count(F.bit_or("variety")).alias("variety")))
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    good = seen.where((F.col("kind") == 0) | (F.col("variety") >= LEAST_VARIETY)).where((F.col("t") >= LEAST_TEXTS)
                      & (F.col("t") >= LEAST_PRECISION * (F.col("t") + F.col("n")))).withColumn("z", F.round(z, 9)).where(F.col("z") >= LEAST_Z)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("z"), "term"))
    best = good.select("kind", "term", place.alias("k")).where(F.col("k") <= F.when(F.col("kind") == 0, MOST_WORDS).otherwise(MOST_PREFIXES)).orderBy("kind", "k").collect()
    return [r["term"] for r in best if r["kind"] == 0], [r["term"] for r in best if r["kind"] == 1]


# --- votes --------------------------------------------------------------------------------------------------

@dataclass
class Voters:
    """What one text makes fire."""

    words: list[str]
    prefixes: list[str]
    plain: set[bytes] = field(default_factory=set)

    #: Words known to hit nothing that a worker remembers.
    MEMO = 300_000

    def __post_init__(self):
        self.word_at = {w.encode(): k for k, w in enumerate(self.words)}
        self.prefix_at = {p: len(self.words) + k for k, p in enumerate(self.prefixes)}
        self.insults = {w.encode() for w in INSULTS}

    def look(self, text: str | None) -> tuple[list[int], list[int], int, int]:
        """Voters that fire, mined terms that occur (numbers), distinct words that hit, words."""
        words = words_of(text)
        if not words:
            return [], [], 0, 0
        fired, terms, hits = set(), set(), 0
        for w in set(words).difference(self.plain):
            own = [self.prefix_at[p] for p in beginnings(w) if p in self.prefix_at]
            if w in self.word_at:
                own.append(self.word_at[w])
            if w in self.insults:
                fired.add(INSULT_VOTER)
            elif not own:
                if len(self.plain) >= self.MEMO:
                    self.plain.clear()
                self.plain.add(w)
                continue
            hits += 1
            terms.update(own)
        fired.update(k % WORD_VOTERS if k < len(self.words) else WORD_VOTERS + (k - len(self.words)) % PREFIX_VOTERS for k in terms)
        fired.update(PATTERN_VOTER + k for k, p in enumerate(_PATTERNS) if p.search(text))
        if not hits and PATTERN_VOTER not in fired:
            fired.add(CLEAN_VOTER)
        return sorted(fired), sorted(terms), hits, len(words)


def votes(df: DataFrame, words: list[str], prefixes: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``fired``, ``terms``, ``hits`` and ``n_words`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(words, prefixes)
        for batch in batches:
            seen = [voters.look(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([s[0] for s in seen], pa.list_(pa.int32())), pa.array([s[1] for s in seen], pa.list_(pa.int32())),
                pa.array([s[2] for s in seen], pa.int64()), pa.array([s[3] for s in seen], pa.int64())], names=[id_col, "fired", "terms", "hits", "n_words"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, fired array<int>, terms array<int>, hits long, n_words long")


# --- label model --------------------------------------------------------------------------------------------

@dataclass
class LabelModel:
    """Rates of every voter on toxic (``on``) and clean (``off``) texts; ``partner`` of dependent ones."""

    prior: float
    on: np.ndarray
    off: np.ndarray
    partner: np.ndarray
    residual: np.ndarray

    def ratios(self) -> np.ndarray:
        return np.log(self.on / self.off)

    def posterior(self, fired: list[int]) -> float:
        odds, seen = np.log(self.prior / (1 - self.prior)), set(fired)
        for j in fired:
            p = self.partner[j]
            if p >= 0 and p in seen:
                rate = [np.clip(r[j] + self.residual[j, p] / r[p], 1e-4, 1) for r in (self.on, self.off)]
                odds += np.log(rate[0] / rate[1])
            else:
                odds += np.log(self.on[j] / self.off[j])
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def fit_label_model(n: int, together: np.ndarray, prior: float, sign: np.ndarray, rounds: int = 6) -> LabelModel:
    """The model from the number of texts and how often voters fire together (their own counts on the diagonal).

    ``sign``: 1 for voters that mean toxic, -1 for those that mean clean.
    """
    m = len(sign)
    mean = (np.diag(together) + 0.5) / (n + 1)
    spread = np.sqrt(mean * (1 - mean))
    corr = (together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    live = np.diag(together) >= 5
    free = np.outer(live, live) & ~np.eye(m, dtype=bool)
    u = np.zeros(m)
    for _ in range(rounds):
        u = np.where(live, 0.3 * sign, 0.0)
        for _ in range(100):
            below = (free * u ** 2).sum(axis=1)
            new = np.divide((free * corr * u).sum(axis=1), below, out=np.zeros(m), where=below > 1e-12)
            u = 0.5 * u + 0.5 * np.clip(np.where(new * sign > 0, new, 0), -0.999, 0.999)
        far = np.abs(corr - np.outer(u, u)) > DEPENDENT
        near = np.outer(live, live) & ~np.eye(m, dtype=bool) & ~far
        near |= (near.sum(axis=1) < 3)[:, None] & np.outer(live, live) & ~np.eye(m, dtype=bool)  # three are needed to tell a rate
        if (near == free).all():
            break
        free = near
    d = u * spread / np.sqrt(prior * (1 - prior))
    on, off = np.clip(mean + (1 - prior) * d, 1e-4, 1 - 1e-4), np.clip(mean - prior * d, 1e-4, 1 - 1e-4)
    off = np.where(sign > 0, np.clip(off, on / MOST_RATIO, on), off)
    on = np.where(sign < 0, np.clip(on, off / MOST_RATIO, off), on)
    on, off = np.where(live, on, mean), np.where(live, off, mean)
    for j, rates in RATES.items():
        if j < m and not live[j]:
            on[j], off[j] = rates
    residual = (corr - np.outer(u, u)) * np.outer(spread, spread)
    tied = np.where(np.outer(live, live), corr - np.outer(u, u), 0)
    partner = np.full(m, -1)
    for j in range(1, m):
        k = int(np.argmax(tied[j, :j]))
        if tied[j, k] > DEPENDENT:
            partner[j] = k
    return LabelModel(prior, on, off, partner, residual)


def firing_table(voted: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and how often each two voters fire together; ``VOTERS`` squared numbers at most."""
    pairs = voted.select(F.explode("fired").alias("i"), "fired").select("i", F.explode("fired").alias("j")).groupBy("i", "j").count()
    out = np.zeros((VOTERS, VOTERS))
    for r in pairs.collect():
        out[r["i"], r["j"]] = r["count"]
    return voted.count(), out


# --- classifier ---------------------------------------------------------------------------------------------

def _extras(hits: np.ndarray, n_words: np.ndarray) -> list[np.ndarray]:
    return [(hits >= 2).astype(float), (hits >= 3).astype(float), np.sqrt(np.divide(hits, n_words, out=np.zeros(len(hits)), where=n_words > 0))]


def _table(rows: pd.DataFrame, terms: int) -> np.ndarray:
    """Rows of the classifier's features; the last column is the constant."""
    out = np.zeros((len(rows), VOTERS + terms + EXTRA + 1))
    for k, (fired, found) in enumerate(zip(rows["fired"], rows["terms"])):
        out[k, list(fired)] = 1
        out[k, [VOTERS + t for t in found]] = 1
    for k, x in enumerate(_extras(rows["hits"].to_numpy(float), rows["n_words"].to_numpy(float))):
        out[:, VOTERS + terms + k] = x
    out[:, -1] = 1
    return out


def fit_classifier(x: np.ndarray, target: np.ndarray, centre: np.ndarray, steps: int = 12) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps, with a ridge around ``centre``."""
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + RIDGE * (w - centre)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scored(voted: DataFrame, weights: np.ndarray, terms: int):
    extra = weights[VOTERS + terms:VOTERS + terms + EXTRA]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for fired, found, hits, n_words in batches:
            odds = np.full(len(fired), weights[-1])
            for lists, shift in ((fired, 0), (found, VOTERS)):
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                if len(row):
                    odds += np.bincount(row, weights=weights[shift + np.concatenate([x for x in lists if len(x)]).astype(int)], minlength=len(lists))
            for w, x in zip(extra, _extras(hits.to_numpy(float), n_words.to_numpy(float))):
                odds += w * x
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    return F.pandas_udf(run, "double")("fired", "terms", "hits", "n_words")


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every row."""
    rows = stored(training_rows(df, labels, id_col, text, label), "toxicity-training")
    words, prefixes = mined_terms(rows)
    voted = stored(votes(df, words, prefixes, id_col, text), "toxicity-votes")
    n, together = firing_table(voted)
    sizes = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(0.5, ((sizes[1] or 0) + 20 * PRIOR) / (sizes[0] + 20))
    sign = np.where(np.arange(VOTERS) == CLEAN_VOTER, -1, 1)
    model = fit_label_model(n, together, prior, sign)

    own = rows.withColumn("_i", F.monotonically_increasing_id())  # at most MAX_LABELLED rows
    seen = votes(own.select("_i", "text"), words, prefixes, "_i").toPandas()
    terms = len(words) + len(prefixes)
    centre = np.concatenate([model.ratios(), np.zeros(terms + EXTRA), [np.log(prior / (1 - prior))]])
    target = np.array([model.posterior(list(f)) for f in seen["fired"]])
    weights = fit_classifier(_table(seen, terms), target, centre)
    scored = voted.withColumn("score", _scored(voted, weights, terms))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
