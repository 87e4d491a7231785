"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

Texts are encoded where they lie, and their ids wait in a table. The counts of all
ids are summed (in each task, then by id), and package-merge gives the best code
lengths of at most ``LONGEST`` bits; code words are canonical, so the lengths alone
are kept. Then a range shuffle sorts the ids, not the texts, by doc_id, and every
range is written as blocks, in files of ascending doc_ids. Spark's own writer holds
the blocks (as a binary column of Parquet), so a lost task is written again and only
whole files count, in any store that Spark reaches.

A block is, little-endian:

    magic "HTB1", documents u32, ids u32, checkpoint distance u32, bits u64
    doc_id i64 and number of ids u32 of each document, a byte each: doc_id is null
    bit offset u32 of every checkpoint (each ``distance`` ids)
    the code words, first bit highest, padded to whole bytes

It decodes alone. The decoder looks up ``LONGEST`` bits at a time in a table and
takes all checkpoints of a block as lanes that advance together.

Cases: null and empty texts hold the end id alone; rows with equal doc_ids are
ordered by a hash of their text; null doc_ids come first; a text longer than a
block fills a block of its own; an empty table gives files without blocks and no
rows back; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm.common import ENCODER_ROWS, id_and_text, library_codec, mapped, new_path, remove, shuffle_partitions

LONGEST = 16
BLOCK_IDS = 1 << 17
DISTANCE = 128
_HEAD = struct.Struct("<4sIIIQ")
_MAGIC = b"HTB1"
_BLOCKS = "shard int, n_docs int, first long, n_tokens long, payload binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code of at most ``longest`` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels = []  # of each level, from the longest codes up: which places of the sorted list are single ids
    packed = np.zeros(0)
    for _ in range(longest):
        merged = np.concatenate([weight, packed])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at][: len(merged) // 2 * 2]
        packed = merged[0::2] + merged[1::2]
    take, rank_lengths = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(levels):
        chosen = int(single[:take].sum())
        rank_lengths[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = rank_lengths
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        at = np.flatnonzero(lengths == size)
        codes[at] = code + np.arange(len(at))
        code = (code + len(at)) << 1
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """For every ``longest`` bits: the id they begin with, and its length."""
    ids, sizes = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.int64)
    used = np.flatnonzero(lengths)
    size = lengths[used].astype(np.int64)
    order = np.lexsort((used, size))
    used, size = used[order], size[order]
    span = np.left_shift(1, longest - size)
    filled = int(span.sum())
    ids[:filled], sizes[:filled] = np.repeat(used, span), np.repeat(size, span)
    return ids, sizes


def encode_block(docs: list[tuple[int | None, bytes]], codes: np.ndarray, lengths: np.ndarray, distance: int = DISTANCE, kind: str = "<u4") -> bytes:
    """One block of documents, each (doc_id, ids as integers of ``kind``)."""
    ids = np.frombuffer(b"".join(raw for _, raw in docs), kind)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    bits = int(ends[-1]) if len(ids) else 0
    start = ends - size
    word = start >> 5
    window = codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    words = -(-bits // 32) + 1
    high = np.bincount(word, weights=window >> np.uint64(32), minlength=words)  # the bits are disjoint: sums are exact
    high += np.bincount(word + 1, weights=window & np.uint64(0xFFFFFFFF), minlength=words)[:words]
    stream = high.astype(np.uint64).astype(">u4").tobytes()[: -(-bits // 8)]
    return b"".join(
        [
            _HEAD.pack(_MAGIC, len(docs), len(ids), distance, bits),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.array([len(raw) // np.dtype(kind).itemsize for _, raw in docs], "<u4").tobytes(),
            bytes(d is None for d, _ in docs),
            start[::distance].astype("<u4").tobytes(),
            stream,
        ]
    )


def decode_block(payload: bytes, table: tuple[np.ndarray, np.ndarray], longest: int = LONGEST) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """A block's doc_ids, numbers of ids, and ids."""
    magic, n_docs, n, distance, bits = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    counts = np.frombuffer(payload, "<u4", n_docs, at + 8 * n_docs)
    nulls = np.frombuffer(payload, np.uint8, n_docs, at + 12 * n_docs)
    at += 13 * n_docs
    lanes = -(-n // distance)
    place = np.frombuffer(payload, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    stream = np.concatenate([np.frombuffer(payload, np.uint8, -(-bits // 8), at), np.zeros(distance * longest // 8 + 8, np.uint8)]).astype(np.uint32)
    three = stream[:-2] << 16 | stream[1:-1] << 8 | stream[2:]
    ids, sizes = table
    out = np.empty((lanes, distance), np.uint32)
    mask = (1 << longest) - 1
    top = len(three) - 1
    for step in range(distance):
        index = three[np.minimum(place >> 3, top)] >> (24 - longest - (place & 7)).astype(np.uint32) & mask
        out[:, step] = ids[index]
        place += sizes[index]
    return [None if z else d for d, z in zip(doc_ids, nulls.tolist(), strict=True)], counts, out.ravel()[:n]


def _ids(batches: Iterator[pa.RecordBatch], path: str | None, end: int, kind: str, memo: int) -> Iterator[pa.RecordBatch]:
    codec = library_codec(path, memo)
    tail = np.array([end], kind)
    for b in batches:
        raw = [np.concatenate([ids.astype(kind), tail]).tobytes() for ids in codec.encode_each(b.column("text"))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "h", "row")), pa.array(raw, pa.binary())], ["doc_id", "h", "row", "ids"])


def _counts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for b in batches:
        found = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind), minlength=len(total))
        found[: len(total)] += total
        total = found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], kind: str, lengths: bytes, block_ids: int) -> Iterator[pa.RecordBatch]:
    """One range's documents in order as blocks; ``first``: the range's ids before a block."""
    from pyspark import TaskContext

    size = np.frombuffer(lengths, np.uint8)
    codes = canonical_codes(size)
    width = np.dtype(kind).itemsize
    waiting: list[tuple[int | None, bytes]] = []
    shard, first, held = TaskContext.get().partitionId(), 0, 0

    def flush() -> pa.RecordBatch:
        row = [[shard], [len(waiting)], [first], [held], [encode_block(waiting, codes, size, kind=kind)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

    for b in batches:
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
            n = len(raw) // width
            if waiting and held + n > block_ids:
                yield flush()
                first, held = first + held, 0
                waiting.clear()
            waiting.append((doc_id, raw))
            held += n
    if waiting:
        yield flush()


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end: int = 2, block_ids: int = BLOCK_IDS, wide: bool = False, memo: int = 600_000) -> None:
    """Write the ids of ``docs(doc_id, text)`` to ``out``: ``codebook`` and ``blocks``, in ranges of ascending doc_ids.

    The texts are encoded once; their ids wait in a table (16 bits each, 32 if
    ``wide``) until the counts of all of them are known.
    ``memo``: pieces of text whose ids a Python worker keeps.
    """
    spark = docs.sparkSession
    kind = "<u4" if wide else "<u2"
    keyed = id_and_text(docs).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    wait = new_path(spark, "ids")
    schema = "doc_id long, h long, row long, ids binary"
    mapped(keyed, partial(_ids, path=path, end=end, kind=kind, memo=memo), schema, ENCODER_ROWS).write.option("compression", "zstd").parquet(wait)
    ids = spark.read.schema(schema).parquet(wait)
    rows = mapped(ids.select("ids"), partial(_counts, kind=kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts).tobytes()
    spark.createDataFrame([(LONGEST, lengths)], "longest int, lengths binary").coalesce(1).write.parquet(f"{out}/codebook")
    order = ("doc_id", "h", "row")
    ranged = ids.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    blocks = mapped(ranged, partial(_blocks, kind=kind, lengths=lengths, block_ids=block_ids), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")
    remove(spark, wait)


def _read(batches: Iterator[pa.RecordBatch], lengths: bytes, longest: int, base: dict[int, int], whole: bool) -> Iterator[pa.RecordBatch]:
    table = decode_table(np.frombuffer(lengths, np.uint8), longest)
    for b in batches:
        for shard, first, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "first", "payload")), strict=True):
            doc_ids, counts, ids = decode_block(payload, table, longest)
            ends = np.cumsum(counts, dtype=np.int64)
            cuts = np.append(0, ends)
            starts = base[shard] + first + cuts[:-1]
            if whole:
                last = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
            else:
                raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * cuts).tolist()
                last = pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts.astype(np.int64)), last], ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])


def read_token_files(spark: SparkSession, out: str, whole: bool = True) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, and its ids (``whole``) or their CRC-32."""
    book = spark.read.schema("longest int, lengths binary").parquet(f"{out}/codebook").first()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")
    shards = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each file
    base, before = {}, 0
    for shard, n in shards:
        base[shard], before = before, before + n
    kind = "ids array<int>" if whole else "ids_crc32 long"
    return mapped(blocks.select("shard", "first", "payload"), partial(_read, lengths=bytes(book["lengths"]), longest=book["longest"], base=base, whole=whole), f"doc_id long, start long, n_tokens long, {kind}")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read the documents back."""
    out = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, out, path)
    return read_token_files(docs.sparkSession, out, whole=False)
