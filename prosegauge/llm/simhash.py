"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit for each of 64 positions, set where more than half of
the text's 3-word shingle hashes (XXH64, seed 42) have it. Two fingerprints that
differ in at most three bits meet at a variant halfway: a fingerprint of even
parity emits its 64 variants at distance one; one of odd parity emits itself,
its 64 variants at distance one, and those at distance two whose two flipped
bits lie in the same half of the word (of any three differing bits, two share a
half). So pairs at distance

* 1 meet at the odd fingerprint itself,
* 2 meet at either variant between them,
* 3 (of opposite parity) meet where the odd one flips two bits of the same half
  and the even one flips the third.

Variants are shuffled as packed arrays, 10 bytes each. At one variant all owners
within distance one are mutual links and each owner at distance two links with
each of them, so a star keeps every component; no pair list is ever made. A
variant has at most 1 + 64 + 992 owners, as fingerprints are deduplicated first:
no key can grow hot.

Cases: null or wordless texts have fingerprint zero and link like any other;
repeated rows and equal texts share a fingerprint; rows with a null doc_id stay,
but name no component unless the whole component has none (then null); other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm import set_similarity
from prosegauge.llm.common import durable, id_and_text, mapped, shuffle_partitions, texts, trimmed
from prosegauge.llm.components import connected_components, forest

#: Variants for one shard of the shuffle, about 25 MB.
SHARD_VARIANTS = 2_500_000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIRS = np.array([_BITS[i] | _BITS[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)], np.uint64)
#: By code: 0 the fingerprint itself, 1..64 one flipped bit, from 65 on two.
MASKS = np.concatenate([np.zeros(1, np.uint64), _BITS, _PAIRS])
_ONE = np.arange(1, 65, dtype=np.uint16)
_ODD = np.arange(len(MASKS), dtype=np.uint16)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text (unsigned)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() changes A-Z alone
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64, n)
    for i in range(0, n, 8192):
        total += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_BITS * (2 * total > n)).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch], kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = np.array([fingerprint(t) for t in texts(b)], np.uint64)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(own.view(np.int64))], [*kept, "fp"])


def _variants(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(0, len(every), 2000):
            fp = every[k : k + 2000]
            odd = np.bitwise_count(fp) % 2 == 1
            o, e = fp[odd], fp[~odd]
            keys = np.concatenate([(o[:, None] ^ MASKS).ravel(), (e[:, None] ^ MASKS[_ONE]).ravel()])
            codes = np.concatenate([np.tile(_ODD, len(o)), np.tile(_ONE, len(e))])
            shard = ((keys * _MIX) >> np.uint64(33)) % np.uint64(shards)
            order = np.argsort(shard.astype(np.uint16 if shards <= 65536 else np.uint32), kind="stable")
            keys, codes, shard = keys[order], codes[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[starts].astype(np.int32)), pa.array([keys[s:t].tobytes() for s, t in zip(starts, ends, strict=True)], pa.binary()), pa.array([codes[s:t].tobytes() for s, t in zip(starts, ends, strict=True)], pa.binary())],
                ["shard", "variants", "codes"],
            )


def meet(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Links (two columns of fingerprints) among the owners of equal variants, verified and deduplicated."""
    order = np.argsort(keys)
    keys, codes = keys[order], codes[order]
    same = keys[1:] == keys[:-1]
    met = np.r_[same, False] | np.r_[False, same]
    keys, codes = keys[met], codes[met]
    order = np.lexsort((codes, keys))
    keys, codes = keys[order], codes[order]
    if not len(keys):
        return np.zeros((0, 2), np.uint64)
    first = np.r_[True, keys[1:] != keys[:-1]]
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    near = (codes[at] <= 64) & ~first
    owner = keys ^ MASKS[codes]
    a, b = owner[at][near], owner[near]
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return found[np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 3]


def _links(shard: pd.DataFrame) -> pd.DataFrame:
    keys = np.frombuffer(b"".join(shard["variants"]), np.uint64)
    codes = np.frombuffer(b"".join(shard["codes"]), np.uint16)
    found = meet(keys, codes).view(np.int64)
    return pd.DataFrame(forest(found.tolist()), columns=["a", "b"], dtype="int64")


def _linked(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that join all fingerprints of ``distinct(fp)`` that are within three bits of one another, fewer than fingerprints in each shard."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(shuffle_partitions(spark), -(-n * 560 // SHARD_VARIANTS))
    parts = max(shuffle_partitions(spark), -(-n // 20_000))
    variants = mapped(distinct.select("fp").repartition(parts), partial(_variants, shards=shards), "shard int, variants binary, codes binary")
    # a partition for each shard, more or less, however many there are
    return variants.repartition(shards, "shard").groupBy("shard").applyInPandas(trimmed(_links), "a long, b long")


def _named(own: DataFrame) -> DataFrame:
    """``fp, component_id``: the least doc_id of each fingerprint's component, of rows ``doc_id, fp``."""
    distinct = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = durable(connected_components(_linked(distinct)), "roots")
    labelled = durable(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    least = durable(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return durable(labelled.join(least, "root").select("fp", "root", "component_id"), "names")


def proposed(ids: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``ids(id, fp)`` that meet by fingerprint, at most one for each row beside one for each link of fingerprints.

    Rows of one fingerprint meet its least id, and the least ids of linked fingerprints meet each other.
    """
    least = durable(ids.groupBy("fp").agg(F.min("id").alias("least")), "least_ids")
    links = durable(_linked(least.select("fp")).distinct(), "fingerprint_links")
    same = ids.join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    left = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
    near = left.join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``."""
    own = durable(mapped(id_and_text(docs), partial(_fingerprints, kept=("doc_id",)), "doc_id long, fp long"), "fingerprints")
    return own.join(_named(own), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least doc_id; of equal doc_ids one whose text hashes least.

    Groups are those of the fingerprints. Where a similarity is given, pairs that
    meet by fingerprint stay linked only if their sets of word shingles have at
    least that Jaccard similarity; pairs that have it and are more than three bits
    apart are then found by their shingles and linked as well. Each row counts for itself, whatever its doc_id: rows that
    share one and have different texts both stay. Of rows equal in doc_id and text
    one stays. Rows without a doc_id can't name a group and stay as they are.
    Columns may have any type and name.
    """
    rows = set_similarity.with_content(docs).where("doc_id is not null")
    own = durable(mapped(rows, partial(_fingerprints, kept=("doc_id", "g", "h")), "doc_id long, g long, h long, fp long"), "fingerprints")
    if similarity is None:
        grouped = own.join(_named(own.select("doc_id", "fp")), "fp").select("doc_id", "g", "h", "root")
    else:
        grouped = set_similarity.groups(docs, shingle, similarity, own)
    each = durable(grouped.groupBy("doc_id", "g", "h").agg(F.first("root").alias("root"), F.count("*").alias("copies")), "each")
    best = each.groupBy("root").agg(F.min(F.struct("doc_id", "g", "h")).alias("r")).select("r.*").withColumn("best", F.lit(True))
    judged = durable(each.join(best, ["doc_id", "g", "h"], "left").select("doc_id", "g", "h", "copies", F.coalesce("best", F.lit(False)).alias("best")), "judged")
    content = [F.xxhash64(F.col("text").cast("string")).alias("g"), F.xxhash64(F.lit(1), F.col("text").cast("string")).alias("h")]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *content, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    # what goes is less than what stays, so the texts need not move where it is small
    out = whole.join(judged.where("not best or copies > 1").select("doc_id", "g", "h"), ["doc_id", "g", "h"], "left_anti").select("own")
    again = judged.where("best and copies > 1").select("doc_id", "g", "h")
    if not again.isEmpty():
        repeated = whole.join(again, ["doc_id", "g", "h"], "left_semi").withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "g", "h").orderBy(F.monotonically_increasing_id())))
        out = out.unionAll(repeated.where("row = 1").select("own"))
    return out.select("own.*")
