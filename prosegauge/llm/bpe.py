"""BPE encoding and decoding with a pair occurrence index.

All distinct new words of a record batch are laid out in one array of symbols.
An index maps each mergeable pair to all its positions in that array; ranks are
taken in ascending order from a heap of active ranks, a rank's merge is applied
at all its positions at once, and the pairs that appear beside the merged
symbols are added to their ranks' lists. Stale positions (a symbol that has been
merged away, or whose right neighbour has changed) are recognised when their
rank's turn comes. That is exact where every merge joins symbols that were made
by earlier merges, as then no merge can wake a smaller rank; it is checked when
the vocabulary is loaded.

Before merging, a text is handled as the vocabulary's own normaliser and
splitter would: special tokens are cut out first, then NFC, white space to one
space, lower case by code point, and the split pattern. None of it looks across
ASCII white space, so pieces between white space are memoised, in a bounded cache.

Cases: null and empty texts have no ids and decode to the empty string;
repeated rows and ties are encoded alike; a symbol the vocabulary lacks is
skipped, as the vocabulary names no unknown token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from prosegauge.llm.common import ENCODER_ROWS, PieceCodec, TwoGenerationCache, byte_alphabet, id_and_text, mapped, vocabulary_path


class Vocabulary:
    """A word-end BPE vocabulary file (tokenizers JSON), as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split, self.spans = regex.compile(patterns[0]).findall, regex.compile(patterns[0]).finditer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        alphabet = byte_alphabet()
        #: The first symbol of each byte: inside a word, and at its end. -1: the vocabulary lacks it.
        self.inner = np.array([self.ids.get(alphabet[b], -1) for b in range(256)], np.int32)
        self.final = np.array([self.ids.get(alphabet[b] + self.suffix, -1) for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int32)
        born = np.full(max(self.tokens) + 1, -1, np.int64)  # the rank that makes a symbol; -1: there from the start
        for rank in range(len(pairs) - 1, -1, -1):
            born[self.made[rank]] = rank
        if not (np.all(born[left] < np.arange(len(pairs))) and np.all(born[right] < np.arange(len(pairs)))):
            raise ValueError("a merge joins symbols of later merges: ascending ranks would not be exact")
        key = left << 20 | right
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text))

    def plain_words(self, text: str) -> list[str]:
        text = self.normalise(text)
        if text.isascii():
            return self.split(text)
        # the split pattern's Unicode tables may be newer than the library's: unassigned characters are no letters
        masked = "".join("\uffff" if unicodedata.category(c) == "Cn" else c for c in text)
        return self.split(text) if masked == text else [text[m.start() : m.end()] for m in self.spans(masked)]

    def words(self, chunk: str) -> list[str | int]:
        """Words of a piece of text; special tokens as their ids."""
        if self.cut is None or "<" not in chunk:
            return self.plain_words(chunk)
        out: list[str | int] = []
        for piece in self.cut(chunk):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += self.plain_words(piece)
        return out


def encode_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in order, and where each word's begin (one more at the end), by the pair occurrence index."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    spelled = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1)  # one empty place ends each word
    n = int(ends[-1])
    raw = np.frombuffer(b"\0".join(spelled) + b"\0", np.uint8)
    symbol = np.append(vocabulary.inner[raw], np.int32(-1))
    symbol[ends - 2] = vocabulary.final[raw[ends - 2]]
    symbol[ends - 1] = -1
    starts = np.append(0, ends)
    lacking = symbol[:n] < 0
    lacking[ends - 1] = False
    if lacking.any():  # a symbol that the vocabulary lacks is skipped
        keep = ~lacking
        starts = np.append(0, np.cumsum(keep))[starts]
        symbol = symbol[np.append(keep, True)]
        n = len(symbol) - 1
    after = np.arange(1, n + 2)
    after[n] = n
    before = np.arange(-1, n)
    before[0] = n
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        rank = vocabulary.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        cuts = [0, *cuts.tolist(), len(at)]
        for i, r in enumerate(rank[cuts[:-1]].tolist()):
            positions = at[cuts[i] : cuts[i + 1]]
            if r in index:
                index[r].append(positions)
            else:
                index[r] = [positions]
                heapq.heappush(heap, r)

    add(np.flatnonzero(symbol[:n] >= 0))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if a == b and len(at) > 1:  # of overlapping pairs the left one merges first
            at = np.sort(at)
            free, taken = [], -1
            for p in at.tolist():
                if p != taken:
                    free.append(p)
                    taken = int(after[p])
                else:
                    taken = -1
            at = np.array(free, np.int64)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        symbol[at] = vocabulary.made[rank]
        symbol[gone] = -2
        after[at] = beyond
        before[beyond] = at
        touched = np.concatenate([at, before[at]])
        add(np.unique(touched[symbol[touched] >= 0]))
    left = symbol[:n] >= 0
    return symbol[:n][left].astype("<u4"), np.append(0, np.cumsum(left))[starts]


class PairIndexCodec(PieceCodec):
    """Encoding of whole texts by pair occurrence indices over the new words of a slice."""

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__(limit)
        self.vocabulary = Vocabulary(path)
        self.memo = TwoGenerationCache(lambda w: self._learn_words([w])[0], limit // 2)

    def _learn_words(self, words: list[str]) -> list[bytes]:
        ids, cuts = encode_words(self.vocabulary, words)
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, pieces: list[str]) -> list[bytes]:
        plain, words, memo = self.vocabulary.split, self.vocabulary.words, self.memo
        split = [plain(p.lower()) if p.isascii() and "<" not in p else words(p) for p in pieces]
        new = memo.missing(w for s in split for w in s if isinstance(w, str))
        memo.update(zip(new, self._learn_words(new), strict=True))
        known = lambda w: memo[w] if isinstance(w, str) else array("I", [w]).tobytes()
        out = [known(s[0]) if len(s) == 1 else b"".join(map(known, s)) for s in split]
        memo.trim()
        return out

    def ids(self, text: str) -> list[int]:
        return next(self.encode_each(pa.array([text]))).tolist()

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        """The tokens joined by spaces: the vocabulary has no decoder of its own. Unknown ids are left out."""
        special = set(self.vocabulary.special.values()) if skip_special_tokens else ()
        return " ".join(self.vocabulary.tokens[i] for i in ids if i in self.vocabulary.tokens and i not in special)


_codecs: dict[str, PairIndexCodec] = {}


def codec(path: str | None = None) -> PairIndexCodec:
    path = path or vocabulary_path()
    if path not in _codecs:
        _codecs[path] = PairIndexCodec(path)
    return _codecs[path]


def _digests(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    top = max(own.vocabulary.tokens) + 1
    names, digits = [own.vocabulary.tokens.get(i, "") for i in range(top)], list(map(str, range(top)))
    for b in batches:
        counts, sums, decoded = [], [], []
        for ids in map(np.ndarray.tolist, own.encode_each(b.column("text"))):
            counts.append(len(ids))
            sums.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for b in batches:
        ids = [x.astype(np.int32) for x in own.encode_each(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs(doc_id, text)``; ``path`` names the vocabulary file on the executors."""
    return mapped(id_and_text(docs), partial(_encoded, path=path), "doc_id long, ids array<int>", ENCODER_ROWS)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of each row of ``encoded(doc_id, ids)``."""
    return mapped(encoded.select("doc_id", "ids"), partial(_decoded, path=path), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids and SHA-256 of ids and decoded text, for each row of ``docs``."""
    return mapped(id_and_text(docs), partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ENCODER_ROWS)
