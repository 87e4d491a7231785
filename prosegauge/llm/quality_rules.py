"""Quality rules: base counts of a text, and how far its histograms diverge from its language's.

Each text has two histograms: kinds of characters, and the commonest words of
its language against all others. They are compared with fixed references of
running text in that language, so a verdict depends on the text and its language
alone, never on the table around it; other references can be passed in. A text is
rejected if either Jensen-Shannon distance (base 2, 0 to 1) is over its
threshold; texts below the minimum lengths are too short to tell and only face
the base rules. One pass over the texts, no shuffle.

Cases: null, empty and wordless texts have no words and fail the base rule; a
null language, or one without references, faces the base rules alone; repeated
rows and ties are treated alike;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import mapped, texts

LEAST_WORDS = 50
#: Shortest texts, in code points and words, whose histograms are compared.
LEAST_CHARS, LEAST_COMMON = 200, 100
MOST_CHARACTERS, MOST_WORDS = 0.30, 0.30

# The commonest words of a language.
COMMON_WORDS = {
    "en": "the of and to in a is it for that on with as was are by be this from at".split(),
    "fr": "de la le les des et en un une du que qui pour par sur dans est au pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}
# Kinds of ASCII characters; those beyond ASCII are a kind of their own.
KINDS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\n\x0b\x0c\r", "stop": ".,;:!?'\"()-", "symbol": "#*$%&|<>"}
# Rounded shares of these kinds, of other ASCII and of characters beyond ASCII in running text.
KIND_SHARES = {
    "en": [0.775, 0.025, 0.005, 0.170, 0.024, 0.0, 0.0005, 0.0005],
    "fr": [0.740, 0.022, 0.005, 0.165, 0.027, 0.0, 0.0005, 0.0405],
    "de": [0.750, 0.050, 0.005, 0.145, 0.025, 0.0, 0.0005, 0.0245],
    "es": [0.760, 0.022, 0.005, 0.165, 0.022, 0.0, 0.0005, 0.0255],
}
#: By Zipf's law the r-th commonest word has about this share, divided by r.
ZIPF = 0.06
SYMBOLS = np.frombuffer(KINDS["symbol"].encode(), np.uint8)
_BINS = len(KINDS) + 2
_KIND = np.full(256, len(KINDS), np.int64)  # other ASCII
for _i, _chars in enumerate(KINDS.values()):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i
_KIND[128:] = len(KINDS) + 1
_FOLLOWS = slice(0x80, 0xC0)  # bytes inside a character
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, characters_js double, words_js double"


def word_shares(n: int) -> list[float]:
    """The shares of a language's ``n`` commonest words, and of all others."""
    own = [ZIPF / r for r in range(1, n + 1)]
    return [*own, 1 - sum(own)]


#: By language: shares of the kinds of characters, and of its common words.
REFERENCES = {lang: (KIND_SHARES[lang], word_shares(len(words))) for lang, words in COMMON_WORDS.items()}


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """The number of words that lie in a window of words found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, total = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + window - max(covered, i)
            covered = i + window
    return total


def divergence(counts: list[int], shares: list[float]) -> float:
    """Jensen-Shannon distance, base 2, of a histogram of counts and one of shares."""
    p, q = np.array(counts, float) / sum(counts), np.array(shares, float)
    q = q / q.sum()
    half = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / half[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def measures(text: str, lang: str | None, references: dict[str, tuple] = REFERENCES) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    count[_FOLLOWS] = 0
    kinds = np.bincount(_KIND, count, _BINS).astype(np.int64)
    chars, spaces = int(count.sum()), int(kinds[3])
    lines = [x for x in raw.split(b"\n") if x.split()]
    far = [None, None]
    if lang in references:
        if chars >= LEAST_CHARS:
            far[0] = divergence(kinds.tolist(), references[lang][0])
        if lang in _COMMON and len(words) >= LEAST_COMMON:
            own = Counter(w.lower() for w in words)
            common = [own[w] for w in _COMMON[lang]]
            far[1] = divergence([*common, len(words) - sum(common)], references[lang][1])
    return len(words), chars - spaces, int(count[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words), *far


_COMMON = {lang: [w.encode() for w in words] for lang, words in COMMON_WORDS.items()}


def _measured(batches: Iterator[pa.RecordBatch], references: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int64()] * 5 + [pa.float64()] * 2
    for b in batches:
        rows = list(zip(*(measures(t, lang, references) for t, lang in zip(texts(b), b.column("lang").to_pylist(), strict=True)), strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(rows, types, strict=True))], names)


def judge(docs: DataFrame, most_characters: float = MOST_CHARACTERS, most_words: float = MOST_WORDS, references: dict[str, tuple] = REFERENCES) -> DataFrame:
    """Counts, distances and verdict of each row of ``docs(doc_id, text, lang)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    measured = mapped(own, partial(_measured, references=references), COLUMNS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("characters_js", F.lit(0.0)) <= most_characters) & (F.coalesce("words_js", F.lit(0.0)) <= most_words)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "characters_js", "words_js")
