"""Shared plumbing: durable intermediate tables, word splitting, bounded caches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.ship import ship

#: Used only when the session names no folder and runs on one machine, as in tests.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Rows and bytes that an operator turns into Python objects at once, whatever the size of a record batch.
SLICE_ROWS, SLICE_BYTES = 1000, 16_000_000
#: The rows where texts are encoded: more rows share more words.
ENCODER_ROWS = 2500
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(DEFAULT_CHECKPOINT_DIR)
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    return durable_at(df, label)[0]


def durable_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most so many rows and, but for longer single rows, bytes of strings and binaries."""
    if batch.num_rows <= 1:
        yield batch
        return
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Return to the system what a worker has freed: workers outlive their tasks, and both allocators keep freed memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(use: Callable) -> Callable:
    """A function of one group that leaves no freed memory behind."""

    def run(group):
        try:
            return use(group)
        finally:
            release()

    return run


def _in_slices(batches: Iterator[pa.RecordBatch], use: Callable, rows: int) -> Iterator[pa.RecordBatch]:
    try:
        yield from use(part for b in batches for part in slices(b, rows))
    finally:
        release()


def mapped(df: DataFrame, use: Callable, schema, rows: int = SLICE_ROWS) -> DataFrame:
    """``df.mapInArrow(use, schema)`` whose workers have the package and see record batches in parts of bounded rows and bytes.

    Spark itself bounds a batch by rows and by spark.sql.execution.arrow.maxBytesPerBatch; no setting of the session is changed.
    """
    ship(df.sparkSession)
    return df.mapInArrow(partial(_in_slices, use=use, rows=rows), schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, in their own types."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def byte_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what bytes.split() separates."""
    return text.encode("utf-8", "surrogatepass").split()


class TwoGenerationCache(dict):
    """A bounded memo: at ``limit`` entries the current generation turns old and the older one is dropped.

    Entries still in use are promoted from the old generation on their next lookup,
    so frequent words stay while memory holds at most ``2 * limit`` entries.
    """

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, keys) -> list:
        """The distinct ``keys`` of which neither generation knows the value."""
        old = self.old
        return [k for k in dict.fromkeys(k for k in keys if k not in self) if k not in old]


class PieceCodec:
    """Encoding of whole texts by way of their pieces between ASCII white space, which are memoised.

    A subclass says what the ids of new pieces are; values of the memo are
    little-endian 32-bit ids. Pieces are split and deduplicated by Arrow and the
    ids gathered by numpy, so Python handles each distinct piece of a slice once.
    """

    #: Bytes of text that are encoded together.
    SLICE = 16_000_000
    #: New pieces that are learnt together.
    LEARN = 100_000
    #: Places of pieces whose ids are gathered together.
    GATHER = 100_000

    def __init__(self, limit: int):
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.cache = TwoGenerationCache(lambda c: self.learn([c])[0], limit)

    def learn(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def values(self, pieces: list[str]) -> list[bytes]:
        cache = self.cache
        found = list(map(cache.get, pieces))
        if None in found:
            old = cache.old
            places = [i for i, v in enumerate(found) if v is None]
            known = {p: v for p in map(pieces.__getitem__, places) if (v := old.get(p)) is not None}
            new = [p for p in map(pieces.__getitem__, places) if p not in known]
            for i in range(0, len(new), self.LEARN):
                some = new[i : i + self.LEARN]
                known.update(zip(some, self.learn(some), strict=True))
            for i in places:
                found[i] = known[pieces[i]]
            cache.update(known)
        cache.trim()
        return found

    def encode_slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        offsets, pieces = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        del lists  # what is no longer needed goes at once: a slice's parts take several times its text
        values = self.values(pieces.dictionary.to_pylist())
        index = pieces.indices.to_numpy(zero_copy_only=False)
        each = np.fromiter(map(len, values), np.int32, len(values)) // 4
        pool, begin = np.frombuffer(b"".join(values), "<u4"), np.cumsum(each, dtype=np.int32) - each  # a slice's ids are far fewer than 2 ** 31
        del values, pieces
        counts = each[index]
        ends = np.append(np.int32(0), np.cumsum(counts, dtype=np.int32))
        ids = np.empty(ends[-1], "<u4")
        for i in range(0, len(index), self.GATHER):
            to = min(i + self.GATHER, len(index))
            shift = begin[index[i:to]] - ends[i:to]
            ids[ends[i] : ends[to]] = pool[np.repeat(shift, counts[i:to]) + np.arange(ends[i], ends[to], dtype=np.int32)]
        return ids, ends[offsets]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts after another, and where each text's begin (one more at the end); nulls are empty."""
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // self.SLICE
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(column)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield self.encode_slice(column.slice(a, b - a))

    def encode_each(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for ids, at in self.encode(column):
            at = at.tolist()
            yield from (ids[a:b] for a, b in zip(at, at[1:], strict=False))


#: Marks that may end a piece without changing how the word before them is encoded.
_ENDS = ".,!?;:*%&#$|"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class LibraryCodec(PieceCodec):
    """The tokenizers library's ids of each piece.

    A piece that is one word of letters, with marks after it or not, is what the
    vocabulary's normaliser and splitter make of it in a known way: lower case,
    the word and the run of marks apart. Such words go to the library in rows of
    a hundred, past the normaliser; the ends of words show in the ids. All other
    pieces go through the whole library one by one.
    """

    ROW = 100
    #: The library's result takes some 150 bytes for each id, so with a memo of at most FRUGAL entries few words go to it together, at some CPU time.
    ROWS, FRUGAL = 50, 100_000

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__(limit)
        self.frugal = limit <= self.FRUGAL
        self.LEARN = 10_000 if self.frugal else self.LEARN
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = Tokenizer(self.tokenizer.model)  # the model is shared; no word of letters alone holds a special token
        self.spaced.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.table = byte_alphabet()
        self.parts = TwoGenerationCache(lambda w: self._words([w])[0], limit // 2)
        self.marks: dict[str, bytes] = {}

    def values(self, pieces: list[str]) -> list[bytes]:
        found = super().values(pieces)
        if self.frugal:
            release()  # the library's results leave the heap in fragments
        return found

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.table) for w in words]
        rows = [" ".join(spelled[i : i + self.ROW]) for i in range(0, len(words), self.ROW)]
        found, step = [], self.ROWS if self.frugal else len(rows)
        for i in range(0, len(rows), step):
            found += [np.array(e.ids, "<u4") for e in self.spaced.encode_batch_fast(rows[i : i + step], add_special_tokens=False)]
        ids = np.concatenate(found)
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != len(words) + 1:
            raise ValueError("the vocabulary does not mark the ends of words")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, pieces: list[str]) -> list[bytes]:
        split = []
        for p in pieces:
            low = p.lower()
            word = low.rstrip(_ENDS)
            if word.isalpha() and (word.isascii() or ("ς" not in word and unicodedata.is_normalized("NFC", word) and len(low) == len(p))):
                split.append((word, low[len(word) :]))
            else:
                split.append((None, p))
        parts, marks = self.parts, self.marks
        new = parts.missing(w for w, _ in split if w)
        parts.update(zip(new, self._words(new), strict=True))
        rare = [p for w, p in split if w is None]
        other = dict(zip(rare, self._pieces(rare), strict=True))
        out = []
        for w, p in split:
            if w is None:
                out.append(other[p])
            elif not p:
                out.append(parts[w])
            else:
                if p not in marks:
                    if len(marks) > 100_000:
                        marks.clear()
                    marks[p] = self._pieces([p])[0]
                out.append(parts[w] + marks[p])
        parts.trim()
        return out


_codecs: dict[tuple[str, int], LibraryCodec] = {}


def library_codec(path: str | None, memo: int = 300_000) -> LibraryCodec:
    """One codec for each Python worker, with ``memo`` entries, about 200 bytes each, in either generation; another vocabulary or size replaces it."""
    key = path or vocabulary_path(), memo
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = LibraryCodec(*key)
    return _codecs[key]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, n: int) -> F.Column:
    """crc32 of a column's decimal text, modulo ``n``: the held-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
