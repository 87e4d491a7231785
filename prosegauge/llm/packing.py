"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a remainder, and the remainder
into pieces of nearly equal length of at most ``piece`` ids. Pieces are dealt by
hash into groups of about ``group`` ids, so a group's work is bounded at any
input size. Within a group the differencing starts with one partial partition
for each piece, takes the two with the largest imbalance and merges them so that
the heavy parts of one meet the light parts of the other, until one partition of
k near-equal windows is left. k starts at the least count that could hold the
ids and rises whenever a window would exceed the capacity. Whole windows need no
balancing and take the group's next sequence numbers.

A cut costs a document some context and saves padding: with the default pieces
of up to 512 ids and a small last piece for each remainder, which differencing
merges last and so evens out the windows, they come out more than 99 % full.

Cases: null and empty texts have the end id alone, one piece of one id; repeated
rows and equal doc_ids are packed once for each row; very long texts are cut
into as many windows as needed; an empty table gives no pieces; a null doc_id
stays null; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import ENCODER_ROWS, durable, id_and_text, library_codec, mapped

CAPACITY = 2048
PIECE = 512
#: The last 8 ids or more, fewer than this above 8, are a small piece that evens out windows.
TAIL = 32
GROUP = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE, tail: int = TAIL) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, the remainder in near-equal pieces, a small last one."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    at, rest = whole * capacity, n % capacity
    last = 8 + n % tail
    if rest <= 4 * last:
        last = 0
    rest -= last
    parts = -(-rest // piece)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        out.append((at, length))
        at += length
    if last:
        out.append((at, last))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, end: int, capacity: int, piece: int, memo: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each text; ``salt``: 64 bits of the document's ids."""
    import xxhash

    codec = library_codec(path, memo)
    tail = np.array([end], "<u4")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
    for b in batches:
        found = []
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), codec.encode_each(b.column("text")), strict=True):
            raw, n = memoryview(np.concatenate([ids, tail]).tobytes()), len(ids) + 1
            salt = xxhash.xxh64_intdigest(raw) - (1 << 63)
            found += [(doc_id, s, k, zlib.crc32(raw[4 * s : 4 * (s + k)]), n, salt) for s, k in cut(n, capacity, piece)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6, names)


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The window (0..k-1) of each size, by Karmarkar-Karp multiway differencing.

    A partial partition is held as its non-zero window sums in descending order,
    each with the root of a tree of the sizes in it.
    """
    n = len(sizes)
    left, right = np.full((2, 2 * n), -1, np.int64)
    made = n
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0:  # the heavy windows of one meet empty windows of the other
            sums, roots = np.concatenate([a, b]), np.concatenate([x, y])
        else:  # a's lightest `both` windows meet b's lightest, light end first
            nodes = np.arange(made, made + both)
            made += both
            if made > len(left):
                left, right = np.concatenate([left, np.full(made, -1)]), np.concatenate([right, np.full(made, -1)])
            left[nodes], right[nodes] = x[len(a) - both :], y[len(b) - both :][::-1]
            sums = np.concatenate([a[: len(a) - both], a[len(a) - both :] + b[len(b) - both :][::-1], b[: len(b) - both]])
            roots = np.concatenate([x[: len(a) - both], nodes, y[: len(b) - both]])
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], roots[order]
        tie += 1
        heapq.heappush(heap, (-(int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)), tie, sums, roots))
    window = np.full(max(made, 1), -1, np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(made - 1, n - 1, -1):  # parents come after their parts
        window[left[node]] = window[right[node]] = window[node]
    return window[:n]


def pack(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """A window for each size with no window over ``capacity``; the count rises until that holds."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while len(sizes):
        window = difference(sizes, k)
        most = int(np.bincount(window, weights=sizes, minlength=k).max())
        if most <= capacity:
            return window
        k = max(k + 1, k * most // capacity)  # near-equal windows shrink as their number grows
    return np.zeros(0, np.int64)


def _pack_group(group: pd.DataFrame, capacity: int, stride: int) -> pd.DataFrame:
    group = group.sort_values(["named", "doc_id", "start", "salt", "ids_crc32", "doc_tokens"], ignore_index=True)
    full = group["length"].to_numpy() == capacity
    window = np.empty(len(group), np.int64)
    window[~full] = pack(group["length"][~full].tolist(), capacity)
    used = int(window[~full].max()) + 1 if (~full).any() else 0
    window[full] = used + np.arange(full.sum())
    order = np.argsort(window, kind="stable")
    group, window = group.iloc[order].reset_index(drop=True), window[order]
    before = np.cumsum(group["length"].to_numpy()) - group["length"].to_numpy()
    first = np.searchsorted(window, window)
    group["sequence_id"] = group["bucket"].to_numpy() * stride + window
    group["offset"] = before - before[first]
    return group[[*(c.split()[0] for c in PACKED.split(", ")), "named"]]


def pack_documents(docs: DataFrame, path: str | None = None, end: int = 1, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, memo: int = 300_000, rows: int = ENCODER_ROWS) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with the sequence and offset of each; ``memo``: pieces of text whose ids a Python worker keeps; ``rows``: texts that it encodes together. Neither changes the pieces."""
    cut_up = mapped(id_and_text(docs), partial(_pieces, path=path, end=end, capacity=capacity, piece=piece, memo=memo), PIECES, rows)
    pieces = durable(cut_up, "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group))
    # groups go by content, so that sequences don't depend on how the table is split; rows that repeat, which may be very many, are dealt by their place
    place = F.xxhash64("doc_id", "salt")
    again = pieces.where("start = 0").groupBy(place.alias("place")).agg(F.count("*").alias("n")).where("n > 1").select("place", F.lit(True).alias("repeated"))
    known = pieces.withColumn("place", place).withColumn("own", F.monotonically_increasing_id()).join(durable(again, "repeated"), "place", "left")
    dealt = known.withColumn("bucket", F.pmod(F.xxhash64("place", "start", F.when(F.col("repeated"), F.col("own"))), F.lit(groups))).drop("place", "own", "repeated")
    # pandas would turn ids beside a null into floats
    whole = dealt.withColumn("named", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def pack_group(one: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(one, capacity, 1 << 32)

    packed = whole.groupBy("bucket").applyInPandas(pack_group, PACKED + ", named boolean")
    return packed.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")
