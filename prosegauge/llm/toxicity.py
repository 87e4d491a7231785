"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, deletes invisible characters, maps look-alike letters and
digit or symbol substitutions to Latin letters, and turns punctuation into
spaces. Lexicon entries are folded alike: whole words, and word beginnings. A
text's matches are weighed, without those inside an exception phrase, and the
sum is normalised by the number of words; a logistic curve turns it into a score.

The lexicon is a short list of English insults and what the labels teach: a word
or word beginning whose occurrences in toxic texts, counted once for each
preceding word so that copied passages count once, are far more frequent than in
other texts (log-likelihood ratio and odds). Labels are learnt from a bounded
sample: of each class the rows with the smallest hashes, at most ``TOXIC_ROWS``
and ``OTHER_ROWS``, so the lexicon, the counts and what the driver gathers are
bounded too; documents are read once for the sample and once to be scored.

Cases: null, empty and wordless texts have no match and get the score of no
match; repeated rows and ties score alike; labels that are null or belong to no
document are ignored, and where a document has several the toxic one counts;
without usable labels the built-in list and a fixed curve score; other columns
of the input are ignored or passed through.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import durable, id_and_text, mapped, texts

#: Labelled rows to learn from, at most, of each class.
TOXIC_ROWS, OTHER_ROWS = 4_000, 12_000
LEAST_RATIO, LEAST_LOG_ODDS = 25.0, 4.0
#: Occurrences outside toxic texts, at most, for each one counted within: whole words, and word beginnings.
MOST_OTHER, MOST_OTHER_BEGINNING = 0.02, 0.0
THRESHOLD = 0.3

# English insults with their weights before labels are seen.
BUILT_IN = {w: 3.0 for w in ("idiot idiots idiotic moron morons moronic imbecile imbeciles scum scumbag scumbags loser losers clown clowns stupid pathetic disgusting worthless trash dumbass dumbasses retard retards bastard bastards bitch bitches asshole assholes cunt cunts slut sluts  faggot faggots vermin subhuman lowlife jackass dipshit shithead").split()}
# Phrases in which such a word insults nobody.
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bag", "trash bags", "take out the trash", "clown fish", "clown car", "class clown", "circus clown", "stupid simple", "keep it simple stupid", "bitch session", "sore loser", "idiot proof", "idiot light", "vermin control"]
# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = dict(zip("аеорсухіјһѕвнтмкαορειυνκτχβη", "aeopcyxijhsbhtmkaopeiuvktxbn", strict=True))
# Digits and symbols written for letters.
DIGITS = dict(zip("013457", "oieast", strict=True))
SYMBOLS = dict(zip("@$!|€", "asiie", strict=True))
# Characters that show nothing.
INVISIBLE = "​‌‍⁠﻿­"

_FOLD = {ord(a): b for a, b in (LOOK_ALIKES | DIGITS).items()} | dict.fromkeys(map(ord, INVISIBLE))
_FOLD |= {c: " " for c in [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 9, 10, 11, 12, 13, 0xA0, 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2010, 0x2028), 0x2026]}
_INNER = re.compile(r"(?<=\w)[@$!|€](?=\w)")


def fold(text: str) -> str:
    """The text as the lexicon sees it: folded words between single or several spaces."""
    text = text.lower()
    if any(c in text for c in SYMBOLS):
        text = _INNER.sub(lambda m: SYMBOLS[m[0]], text)
    return text.translate(_FOLD)


@dataclass
class Model:
    """Folded whole words and word beginnings with weights, and the curve's parameters."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    slope: float = 1.5
    intercept: float = -3.0
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            entries = {f" {w} ": (len(w), v) for w, v in self.words.items()} | {f" {w}": (len(w), v) for w, v in self.beginnings.items()}
            for w, v in list(self.words.items()):  # 1 may stand for l as well as for i
                if "l" in w and w in BUILT_IN:
                    entries.setdefault(f" {w.replace('l', 'i')} ", (len(w), v))
            for phrase in EXCEPTIONS:
                entries[f" {fold(phrase)} "] = (len(phrase), None)
            for key, value in entries.items():
                found.add_word(key, (key.endswith(" "), *value))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def weight(self, text: str) -> tuple[float, int]:
        """The summed weight of a text's matches and its number of words."""
        text = " ".join(["", *fold(text).split(), ""])
        matches, free = [], []
        for end, (closed, length, value) in self.automaton().iter(text):
            last = end - closed
            (free if value is None else matches).append((last - length + 1, last, value))
        if free and matches:
            free.sort()
            starts, reach = [f[0] for f in free], list(accumulate((f[1] for f in free), max))  # how far the phrases up to each go
            matches = [m for m in matches if not (i := bisect_right(starts, m[0])) or reach[i - 1] < m[1]]
        return sum(m[2] for m in matches), text.count(" ") - 1

    def feature(self, text: str) -> float:
        total, words = self.weight(text)
        return math.log1p(100 * total / (words + 10))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.feature(text) + self.intercept))))


def _toxic_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = set()
        for t in texts(b):
            words = fold(t).split()
            for before, w in zip(["", *words], words, strict=False):
                found.add((w + " ", before))
                found.update((w[:n], before) for n in (4, 5) if len(w) > n)
        entry, before = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(before, pa.string())], ["entry", "before"])


def _other_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for t in texts(b):
            for w, n in Counter(fold(t).split()).items():
                found[w + " "] += n
                for k in (4, 5):
                    if len(w) > k:
                        found[w[:k]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([model.feature(t) for t in texts(b)], pa.float64())], ["toxic", "x"])


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept of a ridge-regularised logistic curve, classes weighed alike."""
    rows = np.stack([x, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta, ridge = np.zeros(2), 1e-3 * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-rows @ beta))
        h = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([ridge, 1e-6])
        beta = beta + np.linalg.solve(h, rows.T @ (weight * (y - p)) - np.array([ridge, 1e-6]) * beta)
    return float(beta[0]), float(beta[1])


def training_rows(docs: DataFrame, labels: DataFrame, mark: str, train: Column, most: dict[int, int]) -> DataFrame:
    """``doc_id, text`` and the mark of a bounded sample: of each class the documents with the smallest hashes."""
    marked = labels.where(train & F.col(mark).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(mark).cast("int")).alias(mark))
    parts = [marked.where(F.col(mark) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for value, n in most.items()]
    sample = parts[0].unionByName(parts[1])
    # at most sum(most) rows of two numbers
    return id_and_text(docs).join(F.broadcast(sample), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Model:
    """A model from the labelled documents for which ``train`` (over ``labels``) holds."""
    rows = training_rows(docs, labels, "toxic", F.lit(True) if train is None else train, {1: toxic_rows, 0: other_rows})
    rows = durable(rows.select("toxic", "text"), "sample")  # a bounded sample, which several steps read
    toxic = mapped(rows.where("toxic = 1").select("text"), _toxic_contexts, "entry string, before string").distinct().groupBy("entry").agg(F.count("*").alias("t"))
    other = durable(mapped(rows.where("toxic = 0").select("text"), _other_counts, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("o")), "others")
    counts = toxic.where("t >= 3").join(other, "entry", "left").select("entry", F.col("t").cast("double"), F.coalesce("o", F.lit(0)).cast("double").alias("o"))
    counts = durable(counts, "entries")
    all_t = counts.where("entry like '% '").agg(F.sum("t")).first()[0] or 0.0
    all_o = other.where("entry like '% '").agg(F.sum("o")).first()[0] or 0
    model = Model(words=dict(BUILT_IN))
    if not all_t or not all_o:
        return model
    share = all_t / (all_t + all_o)
    t, o, n = F.col("t"), F.col("o"), F.col("t") + F.col("o")
    ratio = 2 * (t * F.log(t / (n * share)) + F.when(o > 0, o * F.log(o / (n * (1 - share)))).otherwise(0))
    odds = F.log((t + 0.5) / all_t) - F.log((o + 0.5) / all_o)
    rare = o <= t * F.when(F.col("entry").endswith(" "), MOST_OTHER).otherwise(MOST_OTHER_BEGINNING)
    chosen = counts.where(rare).select("entry", ratio.alias("ratio"), odds.alias("odds")).where(f"ratio >= {LEAST_RATIO} and odds >= {LEAST_LOG_ODDS}").collect()  # of the sample's words
    known = {r["entry"]: r["odds"] for r in chosen}
    begin = {e: v for e, v in known.items() if not e.endswith(" ")}
    model.beginnings = {e: v for e, v in begin.items() if not any(e[:k] in begin for k in range(1, len(e)))}
    words = {e[:-1]: v for e, v in known.items() if e.endswith(" ")} | BUILT_IN
    model.words = {w: max(v, known.get(w + " ", 0.0)) for w, v in words.items() if not any(w[:k] in model.beginnings for k in (4, 5) if len(w) > k)}
    found = mapped(rows, partial(_features, model=model), "toxic int, x double").toPandas()
    y = found["toxic"].to_numpy()
    if 0 < y.sum() < len(y):
        model.slope, model.intercept = fit_curve(found["x"].to_numpy(), y)
    return model


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(t) for t in texts(b)], pa.float64())], ["doc_id", "score"])


def _filtered(batches: Iterator[pa.RecordBatch], model, least: float, most: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([least <= model.score(t) < most for t in texts(b)], pa.bool_()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``."""
    return mapped(id_and_text(docs), partial(_scores, model=model), "doc_id long, score double")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    return mapped(docs, partial(_filtered, model=model, least=0.0, most=threshold), docs.schema)
