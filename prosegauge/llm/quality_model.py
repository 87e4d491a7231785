"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a dozen and a half numbers (shares of kinds of characters,
repetition, line shape). Each is cut into bins at quantiles of the training
sample; cyclic boosting visits the features in turn and adds a shallow tree over
one feature's bins, shrunk, to that feature's lookup table, then does the same
over the most useful pairs of features with trees that split each of both once.
A score is the sigmoid of the intercept plus one table entry for each feature
and pair, added by vectorised lookups.

Labels are learnt from a bounded sample: of each class the documents with the
smallest hashes, at most ``ROWS`` of each; the tables' size does not depend on
the data.

Cases: null and empty texts have all features zero and are scored like any
other; repeated rows and ties score alike; null labels and those of no document
are ignored, and where a document has several the better one counts; without
labels of both classes every document scores 1 (nothing is known against any);
other columns of the input are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import id_and_text, mapped, texts
from prosegauge.llm.toxicity import training_rows

#: Labelled rows to learn from, at most, of each class.
ROWS = 8_000
BINS = 32
PAIRS = 6
THRESHOLD = 0.3
FEATURES = ["word_bytes", "upper", "digits", "symbols", "bars", "stops", "marks", "other_ascii", "non_ascii", "next_equal", "distinct", "repeated_lines", "line_words", "longest_line", "log_words", "upper_words"]
_SYMBOLS, _STOPS, _MARKS = (np.frombuffer(x, np.uint8) for x in (b"#*$%&<>", b".,;:", b"!?"))
_OTHER = np.frombuffer(b"\\/{}[]()=+@_~^`\"'-", np.uint8)


def features(text: str) -> list[float]:
    """The numbers of a whole text, as in ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    solid = len(raw) - int(count[9:14].sum()) - int(count[32])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        solid / n,
        upper / max(1, upper + lower),
        int(count[48:58].sum()) / solid,
        int(count[_SYMBOLS].sum()) / n,
        int(count[124]) / n,
        int(count[_STOPS].sum()) / n,
        int(count[_MARKS].sum()) / n,
        int(count[_OTHER].sum()) / n,
        int(count[128:].sum()) / solid,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        max(map(len, lines)) / len(raw),
        float(np.log(n)),
        sum(map(bytes.isupper, words)) / n,
    ]


@dataclass
class Model:
    """Bin edges, the tables of single features and of pairs, and the intercept."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 30.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[at[:, i]]
        for i, j, table in self.pairs:
            total += table[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores(np.array([features(text)]))[0])


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 5.0) -> np.ndarray:
    """The step of each bin from a tree of at most ``leaves`` leaves over sums of gradients ``g`` and curvatures ``h``."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(gl):
                gain = _gain(gl, hl, ridge) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl, ridge) - _gain(g[a:b].sum(), h[a:b].sum(), ridge)
                if (k := int(np.argmax(gain))) >= 0 and gain[k] > best:
                    best, where = gain[k], a + k + 1
        if where is None:
            break
        cuts = sorted({*cuts, where})
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def cross_tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """Gain and steps of the tree over a pair's grid that cuts each feature once, into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    left, top, all_ = (lambda c: c[:-1, -1:]), (lambda c: c[-1:, :-1]), (lambda c: c[-1, -1])
    if cg.shape[0] < 2 or cg.shape[1] < 2:
        return 0.0, np.zeros_like(g)
    parts = [(c[:-1, :-1], left(c) - c[:-1, :-1], top(c) - c[:-1, :-1], all_(c) - left(c) - top(c) + c[:-1, :-1]) for c in (cg, ch)]
    gain = sum(_gain(a, b, ridge) for a, b in zip(*parts, strict=True)) - _gain(all_(cg), all_(ch), ridge)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    step = np.empty_like(g)
    values = [a[i, j] / (b[i, j] + ridge) for a, b in zip(*parts, strict=True)]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, pairs: int = PAIRS) -> Model:
    """Cyclic boosting on ``x`` (rows by features) and labels 0 and 1, both classes weighed alike."""
    model = Model([np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])], intercept=0.0)
    at = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    total = np.zeros(len(y))
    model.tables = [np.zeros(s) for s in size]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for i, s in enumerate(size):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(at[:, i], g, s), np.bincount(at[:, i], h, s))
            model.tables[i] += step
            total += step[at[:, i]]
    g, h = slopes()
    grid = lambda i, j, v: np.bincount(at[:, i] * size[j] + at[:, j], v, size[i] * size[j]).reshape(size[i], size[j])
    useful = sorted(((cross_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(size)) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in useful]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * cross_tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[at[:, i], at[:, j]]
    return model


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([features(t) for t in texts(b)], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = ROWS) -> Model:
    """A model from the labelled documents for which ``train`` (over ``labels``) holds."""
    sample = training_rows(docs, labels, "quality", F.lit(True) if train is None else train, {1: rows, 0: rows})
    found = mapped(sample.select("doc_id", "quality", "text"), _training, "doc_id long, quality int, x array<double>")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toPandas()  # at most 2 * rows
    y = found["quality"].to_numpy() if len(found) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return Model()
    return fit(np.array(found["x"].tolist()), y)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([features(t) for t in texts(b)]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([features(t) for t in texts(b)]).reshape(-1, len(FEATURES))
        yield b.filter(pa.array(model.scores(x) >= threshold, pa.bool_()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``."""
    return mapped(id_and_text(docs), partial(_scores, model=model), "doc_id long, score double")


def remove_poor(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns."""
    return mapped(docs, partial(_kept, model=model, threshold=threshold), docs.schema)
