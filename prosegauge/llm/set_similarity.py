"""Near-duplicates by the exact Jaccard similarity of word shingles.

At a Jaccard similarity of 0.8 the 64-bit SimHashes of two texts differ in about
ten bits, which no affordable ball reaches. Here every pair is found, in three steps.

1. A text whose partner has a similarity t shares at least a share t of its own
   shingles with another text. Shingles are dealt by hash, 6 bytes each, those of a
   task's equal texts once; each text counts its shingles that another text has too,
   and those below t drop out. Shingles that a sample shows to be common are taken
   as shared and do not move, so no key grows hot.
2. Of the others, the suspects, candidates come from a prefix filter, which misses no
   pair: with all shingles in one order, two sets of similarity t share one of the
   first ``n - ceil(t n) + 1`` of each, and at the first shared one enough must be
   left in both. Any order is right; here it is by the number of suspects that have a
   shingle, exact but for the common ones. Those of one text alone fill its prefix
   first and are never looked up, and a passage that many texts quote comes after
   what only near copies have in common.
3. Every candidate pair is checked on its whole sets.

Where fingerprints are given, the pairs that meet by them (``simhash.proposed``) are
checked like any other, together with the first links below.

Texts that meet at a shingle are first linked with a few of them, its hubs; only
pairs whose components still differ are then compared all, and none within a
shingle's largest component, so a large group of near copies stays linear. Those
comparisons are of 512 parities: each shingle of a text flips one of its bits, so two
texts differ in at least as many shingles as their parities in bits. Only pairs that
this bound leaves are made and checked.

Cases: texts that are equal but for ASCII case and white space are one from the
start, null and wordless ones among them; a text shorter than a shingle is one
shingle; rows may repeat and share a doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import durable, id_and_text, mapped, shuffle_partitions, texts, trimmed
from prosegauge.llm.components import connected_components

#: Texts whose shingles are counted, and how often one must occur there to count as common.
SAMPLE, LEAST_COUNT, MOST_COMMON = 20_000, 3, 500_000
#: Shingles and postings for one shard of a shuffle, about 40 MB in a task.
SHARD_TOKENS, SHARD_POSTINGS = 2_000_000, 1_500_000
#: Shingles of a text, roughly: sizes the shards before texts are read.
WORDS = 400
HUBS = 3
#: Parities of a set, in integers of 64 bits.
PARITIES = 8
_ODD = [f"p{k}" for k in range(PARITIES)]
ENTRY = np.dtype([("token", "<u8"), ("id", "<i8"), ("n", "<i4"), ("df", "<i4")])
COUNT = np.dtype([("key", "<i8"), ("c", "<i4"), ("n", "<i4")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() changes A-Z alone


def shingles(text: str, shingle: int) -> np.ndarray:
    """The distinct shingle hashes (XXH64, seed 42) of a text, ascending."""
    import xxhash

    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64, max(1, len(words) - shingle + 1)))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def with_content(docs: DataFrame) -> DataFrame:
    """``doc_id, g, h, text``: a row is known by its doc_id and 128 bits of its text."""
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("g"), F.xxhash64(F.lit(1), "text").alias("h"), "text")


def _packed(shard: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows as one binary for each shard."""
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    starts, ends = np.r_[0, cuts][: len(rows)], np.r_[cuts, len(rows)][: len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), pa.array([rows[s:t].tobytes() for s, t in zip(starts, ends, strict=True)], pa.binary())], ["shard", "packed"])


def _shards(tokens: np.ndarray, shards: int) -> np.ndarray:
    return ((tokens * _MIX) >> np.uint64(33)) % np.uint64(shards)


def _sampled(batches: Iterator[pa.RecordBatch], shingle: int, shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t, shingle) for t in texts(b)]
        if own:
            every = np.concatenate(own)
            yield _packed(_shards(every, shards), every)


def _counted(shard: pd.DataFrame) -> pd.DataFrame:
    tokens, n = np.unique(np.frombuffer(b"".join(shard["packed"]), np.uint64), return_counts=True)
    often = n >= LEAST_COUNT
    return pd.DataFrame({"token": tokens[often].view(np.int64), "n": n[often]})


def _is_common(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(own), bool)
    return common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own


def text_key(text: str) -> bytes:
    """128 bits of a text's words."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(_words(text)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [text_key(t) for t in texts(b)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "g", "h")), pa.array(keys, pa.binary()), pa.array(list(map(short_key, keys)), pa.int64())], ["doc_id", "g", "h", "key", "short"])


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _dealt(batches: Iterator[pa.RecordBatch], shingle: int, common: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """The shingles of each text that are not common, by shard, with the texts' short keys; as shard -1 the keys with the numbers of all and of common shingles."""
    names = ["shard", "tokens", "owners", "keys"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    for b in batches:
        each = {short_key(text_key(t)): t for t in texts(b)}
        if not each:
            continue
        keys = np.array(list(each), np.int64)
        own = [shingles(t, shingle) for t in each.values()]
        often = [_is_common(x, common) for x in own]
        sizes = np.array([[len(x), int(o.sum())] for x, o in zip(own, often, strict=True)], np.int32)
        rows = [(-1, sizes.tobytes(), b"", keys.tobytes())]
        rest = [x[~o] for x, o in zip(own, often, strict=True)]
        tokens = np.concatenate(rest)
        owner = np.repeat(np.arange(len(rest), dtype=np.uint16), [len(x) for x in rest])
        shard = _shards(tokens, shards)
        order = np.argsort(shard, kind="stable")
        tokens, owner, shard = tokens[order].astype(np.uint32), owner[order], shard[order]  # the shard and 32 bits: taking two for one only keeps a text
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
        for s, t in zip(cuts, cuts[1:], strict=False):
            present, local = np.unique(owner[s:t], return_inverse=True)
            rows.append((int(shard[s]), tokens[s:t].tobytes(), local.astype(np.uint16).tobytes(), keys[present].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _counts_by_key(key: np.ndarray, c: np.ndarray, n: np.ndarray | int, shards: int) -> pd.DataFrame:
    rows = np.empty(len(key), COUNT)
    rows["key"], rows["c"], rows["n"] = key, c, n
    if not len(rows):
        return pd.DataFrame({"shard": [], "packed": []}).astype({"shard": "int32"})
    return _packed(_shards(rows["key"].view(np.uint64), shards), rows).to_pandas()


def _shared(shard: pd.DataFrame, shards: int) -> pd.DataFrame:
    """How many of its shingles in a shard each text shares with another text, packed by key; of shard -1 the sizes."""
    if shard["shard"].iloc[0] < 0:
        key = np.frombuffer(b"".join(shard["keys"]), np.int64)
        sizes = np.frombuffer(b"".join(shard["tokens"]), np.int32).reshape(-1, 2)
        key, first = np.unique(key, return_index=True)
        return _counts_by_key(key, sizes[first, 1], sizes[first, 0], shards)
    tokens = np.frombuffer(b"".join(shard["tokens"]), np.uint32)
    key = np.concatenate([np.frombuffer(k, np.int64)[np.frombuffer(o, np.uint16)] for k, o in zip(shard["keys"], shard["owners"], strict=True)])
    order = np.lexsort((key, tokens))
    tokens, key = tokens[order], key[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (key[1:] != key[:-1])] if len(tokens) else np.zeros(0, bool)
    tokens, key = tokens[new], key[new]  # of copies of a text one counts
    same = tokens[1:] == tokens[:-1]
    found, n = np.unique(key[np.r_[same, False] | np.r_[False, same]] if len(tokens) else key, return_counts=True)
    return _counts_by_key(found, n, 0, shards)


def _enough(shard: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The keys of the texts that share enough of their shingles."""
    rows = np.frombuffer(b"".join(shard["packed"]), COUNT)
    sized = rows[rows["n"] > 0]
    keys, first = np.unique(sized["key"], return_index=True)  # several tasks' copies of a text say the same
    n, often = sized["n"][first], sized["c"][first].astype(np.int64)
    rest = rows[rows["n"] == 0]
    rest = rest[np.isin(rest["key"], keys)]
    total = often + np.bincount(np.searchsorted(keys, rest["key"]), rest["c"], len(keys)).astype(np.int64)
    return pd.DataFrame({"short": keys[total >= similarity * n - 1e-9]})


def _entries(batches: Iterator[pa.RecordBatch], common: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Every shingle of each set with its owner: common ones, whose number is known, by owner (shards from ``shards`` on), others by shingle."""
    for b in batches:
        out = []
        for i, raw in zip(b.column("id").to_pylist(), b.column("own").to_pylist(), strict=True):
            own = np.frombuffer(raw, np.uint64)
            rows = np.empty(len(own), ENTRY)
            rows["token"], rows["id"], rows["n"], rows["df"] = own, i, len(own), 0
            often = _is_common(own, common)
            rows["df"][often] = counts[np.searchsorted(common, own[often])]
            out.append(rows)
        if out:
            rows = np.concatenate(out)
            known = rows["df"] > 0
            yield _packed(np.where(known, _shards(rows["id"].view(np.uint64), shards) + np.uint64(shards), _shards(rows["token"], shards)), rows)


def _numbered(shard: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The entries of shingles that several sets have, with their number, by owner."""
    at, rows = int(shard["shard"].iloc[0]), np.frombuffer(b"".join(shard["packed"]), ENTRY)
    if at < shards:
        _, index, n = np.unique(rows["token"], return_inverse=True, return_counts=True)
        rows = rows.copy()
        rows["df"] = n[index]
        rows = rows[rows["df"] > 1]
    return _packed(_shards(rows["id"].view(np.uint64), shards), rows).to_pandas() if len(rows) else pd.DataFrame({"shard": [], "packed": []}).astype({"shard": "int32"})


def _prefixes(shard: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The shared shingles within each set's prefix, and their places."""
    rows = np.frombuffer(b"".join(shard["packed"]), ENTRY)
    rows = rows[np.lexsort((rows["token"], rows["df"], rows["id"]))]
    new = np.r_[True, rows["id"][1:] != rows["id"][:-1]]
    start = np.flatnonzero(new)
    each = np.diff(np.r_[start, len(rows)])
    alone = rows["n"][start] - each  # no other set has these, which come first
    at = np.arange(len(rows)) - np.repeat(start, each) + np.repeat(alone, each)
    first = rows["n"] - np.ceil(similarity * rows["n"] - 1e-9).astype(np.int64) + 1
    keep = at < first
    return pd.DataFrame({"token": np.ascontiguousarray(rows["token"][keep]).view(np.int64), "id": rows["id"][keep], "n": rows["n"][keep], "at": at[keep].astype(np.int32)})


def parities(own: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles by their last nine bits, as integers of 64 bits."""
    odd = np.bincount((own & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t, shingle) for t in texts(b)]
        odd = np.array([parities(x) for x in own]).reshape(-1, PARITIES)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in own], pa.binary()), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(PARITIES))], ["id", "own", *_ODD])


def _checked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("x", "y")]
        yield b.select(["a", "b"]).filter(pa.array([alike(x, y, similarity) for x, y in zip(*sets, strict=True)], pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar enough."""
    sets = sets.select("id", "own")
    left = pairs.distinct().join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    return durable(mapped(both, partial(_checked, similarity=similarity), "a long, b long", 200), label)


def _common_shingles(rows: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several texts of a sample, ascending, and in how many."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows if share == 1 else rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    shards = max(shuffle_partitions(spark), int(n * share) * WORDS // SHARD_TOKENS + 1)
    packed = mapped(sample.dropDuplicates(["g", "h"]), partial(_sampled, shingle=shingle, shards=shards), "shard int, packed binary")
    often = packed.groupBy("shard").applyInPandas(trimmed(_counted), "token long, n long").orderBy(F.desc("n"), "token").limit(MOST_COMMON).toPandas()  # decides what is compared first, not what is found
    common, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(common)
    return common[order], counts[order]


def _suspects(rows: DataFrame, n: int, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """``short``: the short keys of the texts that share enough shingles with other texts to have a partner."""
    shards = max(shuffle_partitions(rows.sparkSession), n * WORDS // SHARD_TOKENS + 1)
    dealt = mapped(rows.select("text"), partial(_dealt, shingle=shingle, common=common, shards=shards), "shard int, tokens binary, owners binary, keys binary")
    # the sizes of all texts would be one group
    spread = dealt.withColumn("part", F.when(F.col("shard") < 0, F.xxhash64("keys") % shards).otherwise(F.lit(0)))

    def shared(shard: pd.DataFrame) -> pd.DataFrame:
        return _shared(shard, shards)

    def enough(shard: pd.DataFrame) -> pd.DataFrame:
        return _enough(shard, similarity)

    counts = spread.repartition(shards, "shard", "part").groupBy("shard", "part").applyInPandas(trimmed(shared), "shard int, packed binary")
    return counts.repartition(shards, "shard").groupBy("shard").applyInPandas(trimmed(enough), "short long")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, fingerprints: DataFrame | None = None) -> DataFrame:
    """``doc_id, g, h, root`` for each row of ``docs(doc_id, text)`` that has a doc_id; ``fingerprints(doc_id, g, h, fp)`` propose pairs.

    Texts of at least the given similarity are linked; a component bears the number of one of its texts.
    """
    spark = docs.sparkSession
    rows = with_content(docs).where("doc_id is not null")
    n, least = rows.count(), shuffle_partitions(spark)
    common, counts = _common_shingles(rows, n, shingle)
    own = durable(mapped(rows, _keys, "doc_id long, g long, h long, key binary, short long"), "own")
    distinct = durable(own.groupBy("key", "short").agg(F.min(F.struct("doc_id", "g", "h")).alias("r")).select(F.monotonically_increasing_id().alias("id"), "key", "short", "r"), "distinct")
    suspects = durable(_suspects(rows, n, shingle, similarity, common), "suspects")
    needed = durable(distinct.join(suspects, "short", "left_semi").select("id", "r.doc_id", "r.g", "r.h"), "needed")
    found = mapped(rows.join(needed, ["doc_id", "g", "h"]).select("id", "text"), partial(_sets, shingle=shingle), "id long, own binary, " + ", ".join(f"{c} long" for c in _ODD))
    sets = durable(found.groupBy("id").agg(*[F.first(c).alias(c) for c in ("own", *_ODD)]), "sets")  # rows may repeat

    total = sets.agg(F.sum(F.length("own"))).first()[0] or 0
    shards = max(least, total // 8 // SHARD_POSTINGS + 1)

    def numbered(shard: pd.DataFrame) -> pd.DataFrame:
        return _numbered(shard, shards)

    def prefixes(shard: pd.DataFrame) -> pd.DataFrame:
        return _prefixes(shard, similarity)

    packed = "shard int, packed binary"
    entries = mapped(sets.select("id", "own"), partial(_entries, common=common, counts=counts, shards=shards), packed).withColumn("part", F.when(F.col("shard") >= shards, F.spark_partition_id()).otherwise(F.lit(0)))
    by_owner = entries.repartition(2 * shards, "shard", "part").groupBy("shard", "part").applyInPandas(trimmed(numbered), packed)
    met = durable(by_owner.repartition(shards, "shard").groupBy("shard").applyInPandas(trimmed(prefixes), "token long, id long, n int, at int"), "met")

    # sizes that allow the similarity, and enough shingles left in both after the one at which they meet
    fits = (F.col("n") >= similarity * F.col("m") - 1e-9) & (F.col("m") >= similarity * F.col("n") - 1e-9)
    fits &= F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    hubs = met.groupBy("token").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("hub"), F.col("n").alias("m"), F.col("at").alias("bt"))).alias(f"h{k}") for k in range(HUBS)])
    hubs = durable(hubs.select("token", F.explode(F.array_distinct(F.array(*[F.struct(f"h{k}.hub", f"h{k}.m", f"h{k}.bt") for k in range(HUBS)]))).alias("x")).select("token", "x.*"), "hubs")
    near = met.join(hubs, "token").where((F.col("id") != F.col("hub")) & fits).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    if fingerprints is not None:
        from prosegauge.llm.simhash import proposed

        ids = durable(distinct.select("id", "r.*").join(fingerprints.distinct(), ["doc_id", "g", "h"]).select("id", "fp"), "ids")
        near = near.unionByName(proposed(ids))
    links = _links(near, sets, similarity, "hub_links")
    roots = durable(connected_components(links), "hub_roots")

    known = sets.select("id", *_ODD).join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    at = durable(met.join(known, "id"), "rooted")
    sizes = at.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("k"))
    major = durable(sizes.where("k > 1").select("token", F.col("most.root").alias("major")), "major")
    open_ = at.join(major, "token")
    others = open_.where("root <> major").drop("major")
    right = open_.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("root").alias("s"), (F.col("root") == F.col("major")).alias("in_major"), *[F.col(c).alias(f"{c}_b") for c in _ODD])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in _ODD), F.lit(0))
    close = apart <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-6
    rest = others.join(right, "token").where((F.col("root") != F.col("s")) & (F.col("in_major") | (F.col("id") < F.col("b"))) & fits & close)
    more = _links(rest.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")), sets, similarity, "links")
    if not more.isEmpty():
        roots = durable(connected_components(links.unionByName(more)), "roots")

    names = durable(distinct.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", F.coalesce("root", "id").alias("root")), "names")
    return own.join(names, "key").select("doc_id", "g", "h", "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs(doc_id, text)`` that has a doc_id; a component bears its least doc_id."""
    found = durable(groups(docs, shingle, similarity), "groups")
    least = durable(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "root").select("doc_id", "component_id")
