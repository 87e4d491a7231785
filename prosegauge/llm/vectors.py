"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label (and one length) are compared by cosine in double
precision. Equal vectors are merged first and weigh as many as they are. Unit
vectors are turned onto the principal axes of all vectors, so that leading
coordinates carry most of the distance; they are sorted along a curve through a
grid over several leading axes and dealt into tiles of bounded size by a range
shuffle, so a tile is narrow on each of these axes. Two unit vectors with cosine c
are sqrt(2 - 2c) apart, so only tiles whose boxes come that close are compared:
boxes meet by the cells of that width that they reach on the first axes, which
enumerates close pairs alone. Pairs of tiles are compared in blocks, so a tile
moves once for each block that needs it and not for each pair.

Within a pair of tiles leading coordinates are multiplied first; what
the rest can add is at most the product of the suffix norms, so rows and columns
that cannot reach the threshold any more drop out before the next chunk of
coordinates. A block returns, for each of its vectors, how many it
links with, and a spanning forest of the links: never the pairs themselves.

The links' number is a property of the data (n_links counts all of them), and
the comparison of tiles that stay close is quadratic within a label.

Cases: vectors that are null, empty or zero or hold null or non-finite
components, and those without a label, link with nothing and are components of
their own; vectors so small or large that squares of their components leave the
range of doubles are scaled by a power of two first, which changes no cosine;
vectors of unequal length never link; repeated rows link as equal
vectors do; rows with a null vec_id count as links but name no component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import durable, mapped, shuffle_partitions
from prosegauge.llm.components import connected_components, forest

THRESHOLD = 0.98
TILE = 1024
CHUNK = 16
#: Axes of the grid along which vectors are sorted, and bits on each.
GRID_AXES, GRID_BITS = 6, 3
#: Leading axes on whose cells boxes meet.
CELL_AXES = 2
#: Tiles in a row that move together.
BLOCK = 8
#: Distance from the threshold within which a cosine is computed again from the vectors themselves.
_NEAR = 1e-9


def _matrix(column: list[list[float]]) -> np.ndarray:
    return np.array(column, np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        by: dict[int, list] = {}
        for v in b.column("v").to_pylist():
            by.setdefault(len(v), []).append(v)
        for d, rows in by.items():
            x = _matrix(rows)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["d", "i", "row"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of ``v``: orthonormal axes, most spread first, from the second moments of all vectors."""
    partial_sums = mapped(vectors.select("v"), _moments, "d int, i int, row array<double>")
    flat = partial_sums.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in flat.collect():  # one number for each pair of coordinates
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in out.items()}


def curve(leading: np.ndarray) -> np.ndarray:
    """The place of each row on a Z-shaped curve through a grid over its leading coordinates, the first axis in front.

    A coordinate of a unit vector of d components is about 1 / sqrt(d) large; the
    cells follow that scale, so the grid needs no counts.
    """
    top = 1 << GRID_BITS
    cell = np.clip(np.floor(leading * (top / 2) + top / 2), 0, top - 1).astype(np.int64)
    place = np.zeros(len(leading), np.int64)
    for bit in range(GRID_BITS - 1, -1, -1):
        for axis in range(leading.shape[1]):
            place = place << 1 | cell[:, axis] >> bit & 1
    return place


def _project(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        place, first = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
        vectors = b.column("v").to_pylist()
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for d, at in by.items():
            x = _matrix([vectors[i] for i in at])
            leading = x @ axes[d][:, :GRID_AXES] / np.linalg.norm(x, axis=1, keepdims=True)
            first[at] = leading[:, 0]
            place[at] = curve(leading * np.sqrt(d) / 2)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(first)], [*b.schema.names, "place", "first"])


def _tiles(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of one label and length as tiles, each with its box on the leading axes."""
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    key = None

    def flush() -> pa.RecordBatch:
        nonlocal made, held
        x = _matrix([h[1] for h in held])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) @ axes[key[1]][:, :CHUNK]
        row = [(task << 32) + made, key[0], key[1], unit.min(0).tolist(), unit.max(0).tolist(), np.array([h[0] for h in held], np.int64).tobytes(), np.array([h[2] for h in held], np.int64).tobytes(), x.astype(np.float32).tobytes() if np.array_equal(x, x.astype(np.float32)) else x.tobytes(), len(held)]
        made, held = made + 1, []
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["tile", "label", "d", "low", "high", "ids", "copies", "data", "n"])

    for b in batches:
        for label, v, id_, copies in zip(*(b.column(c).to_pylist() for c in ("label", "v", "id", "copies")), strict=True):
            if held and (key != (label, len(v)) or len(held) >= size):
                yield flush()
            key = (label, len(v))
            held.append((id_, v, copies))
    if held:
        yield flush()


_TILES = "tile long, label string, d int, low array<double>, high array<double>, ids binary, copies binary, data binary, n int"


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column numbers of the pairs with cosine >= threshold, in blocks of rows.

    ``a`` and ``b`` hold vectors as rows. Products are summed over chunks of
    principal coordinates; after each chunk rows and columns none of whose pairs
    can reach the threshold drop out.
    """
    na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
    ua, ub = a / na @ axes, b / nb @ axes
    d = axes.shape[1]
    rest = lambda u: np.sqrt(np.maximum(0.0, np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1]))
    ra, rb = rest(ua), rest(ub)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    done = np.zeros((len(a), len(b)))
    for start in range(0, d, CHUNK):
        end = min(start + CHUNK, d)
        done += ua[rows, start:end] @ ub[cols, start:end].T
        if end < d:
            may = done + ra[rows, end][:, None] * rb[cols, end] >= threshold - _NEAR
            keep_r, keep_c = may.any(1), may.any(0)
            if not keep_r.any():
                return
            if keep_r.sum() * keep_c.sum() < 0.8 * may.size:
                rows, cols, done = rows[keep_r], cols[keep_c], done[np.ix_(keep_r, keep_c)]
    for k in range(0, len(rows), 256):
        i, j = np.nonzero(done[k : k + 256] >= threshold - _NEAR)
        value = done[k : k + 256][i, j]
        i, j = rows[k : k + 256][i], cols[j]
        edge = value < threshold + _NEAR
        if edge.any():
            x, y = a[i[edge]], b[j[edge]]
            exact = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            good = np.ones(len(i), bool)
            good[edge] = exact >= threshold
            i, j = i[good], j[good]
        yield i, j


def _compared(group: pd.DataFrame, axes: dict[int, np.ndarray], threshold: float) -> pd.DataFrame:
    """Of one block of tile pairs: how many links each vector has there, and the root of its component there."""
    tiles, links = {}, {}
    for r in group.itertuples(index=False):
        kind = np.float32 if len(r.data) == 4 * r.n * r.d else np.float64
        tiles[r.tile] = np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64), np.frombuffer(r.data, kind).reshape(r.n, r.d).astype(np.float64)
        links[r.tile] = np.zeros(r.n, np.int64)
    parent: list[tuple[int, int]] = []
    for r in group.itertuples(index=False):
        ids_a, copies_a, a = tiles[r.tile]
        for other in sorted(r.partners):
            ids_b, copies_b, b = tiles[other]
            same = other == r.tile
            for i, j in close_pairs(a, b, axes[r.d], threshold):
                if same:
                    i, j = i[i != j], j[i != j]
                np.add.at(links[r.tile], i, copies_b[j])
                if same:
                    i, j = i[i < j], j[i < j]
                else:
                    np.add.at(links[other], j, copies_a[i])
                parent = forest([*parent, *zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True)])
    roots = dict(parent)
    out = []
    for tile, n in links.items():
        at = np.flatnonzero(n)
        found = tiles[tile][0][at]
        out.append(pd.DataFrame({"id": found, "links": n[at], "root": [roots.get(x, x) for x in found.tolist()]}, dtype="int64"))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")


def _scaled(v: Column) -> Column:
    """A vector whose squares are within the range of doubles, by a power of two."""
    most = F.array_max(F.transform(v, F.abs))
    power = F.floor(F.log2(most))
    half = F.floor(power / 2)
    return F.when((most > 1e-100) & (most < 1e100), v).otherwise(F.transform(v, lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power)))


def close_tiles(boxes: DataFrame, threshold: float) -> DataFrame:
    """``tile, other``: pairs of tiles of one label and length, each with itself too, whose boxes come as close as the threshold asks."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    axes = range(CELL_AXES)
    low, high = ([F.floor(F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) / F.lit(reach)).cast("int") for i in axes] for c in ("low", "high"))
    wide = [F.sequence(low[i], high[i] + 1) for i in axes]
    cells = F.flatten(F.transform(wide[0], lambda x: F.transform(wide[1], lambda y: F.struct(x.alias("x"), y.alias("y")))))
    spread = boxes.select("tile", "label", "d", "low", "high", F.struct(low[0].alias("x"), low[1].alias("y")).alias("least"), F.explode(cells).alias("cell"))

    # of two boxes that reach a common cell once both are widened by one, the pair is made in the largest of their first cells
    b = spread.select(F.col("tile").alias("other"), "label", "d", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("least").alias("least_b"), "cell")
    gap = F.zip_with(F.zip_with("low", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    here = (F.col("cell.x") == F.greatest("least.x", "least_b.x")) & (F.col("cell.y") == F.greatest("least.y", "least_b.y"))
    return spread.join(b, ["label", "d", "cell"]).where((F.col("tile") <= F.col("other")) & here & (apart <= 2 - 2 * threshold + 1e-9)).select("tile", "other")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id`` for each row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v")).select("vec_id", "label", "v", F.coalesce(good, F.lit(False)).alias("good"))
    rows = durable(rows.withColumn("v", F.when(F.col("good"), _scaled(F.col("v")))), "vectors")
    # equal vectors are one, named by a hash of label and components: 64 + 64 bits tell them apart
    h = F.struct(F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit(1), "v", "label").alias("g"))
    named = rows.where("good").select("vec_id", "label", "v", h.alias("k"))
    distinct = named.groupBy("k").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = durable(distinct.select(F.monotonically_increasing_id().alias("id"), "k", "label", "v", "copies", "least"), "distinct")
    axes = principal_axes(distinct)
    projected = mapped(distinct.select("id", "label", "v", "copies"), partial(_project, axes=axes), "id long, label string, v array<double>, copies long, place long, first double")
    projected = projected.withColumn("d", F.size("v"))
    order = ("label", "d", "place", "first", "id")
    dealt = projected.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    tiles = durable(mapped(dealt.select("label", "v", "id", "copies"), partial(_tiles, axes=axes, size=tile), _TILES), "tiles")
    pairs = close_tiles(tiles.select("tile", "label", "d", "low", "high"), threshold)
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    pairs = durable(pairs.select(block("tile").alias("x"), block("other").alias("y"), "tile", "other"), "pairs")
    partners = pairs.groupBy("x", "y", "tile").agg(F.collect_set("other").alias("partners"))  # at most BLOCK each
    both = partners.unionByName(pairs.select("x", "y", F.col("other").alias("tile"), F.array().cast("array<bigint>").alias("partners")).distinct())
    needed = both.groupBy("x", "y", "tile").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    moved = needed.join(tiles.select("tile", "d", "ids", "copies", "data", "n"), "tile")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _compared(group, axes, threshold)

    found = durable(moved.groupBy("x", "y").applyInPandas(compare, "id long, links long, root long"), "found")
    links = durable(found.groupBy("id").agg(F.sum("links").alias("links")), "links")
    roots = durable(connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))), "roots")
    named_roots = distinct.select("id", "k", "copies", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named_roots = durable(named_roots.join(links, "id", "left").select("k", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = durable(named_roots.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    final = durable(named_roots.join(least, "root").select("k", "n_links", "component_id"), "final")
    linked = named.select("vec_id", "k").join(final, "k").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
