"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import durable_at, remove


def forest(pairs) -> list[tuple[int, int]]:
    """Union-find over one task's links: the same components with fewer links than nodes, as (node, root)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the smallest node of its component.

    Nodes without links don't appear, self-links and nulls are ignored, and an
    empty input gives an empty result. Every round ends in a written table.
    Minima are combined before the shuffle, and the lookups of minima join two
    plain tables so that adaptive execution can split a hub's rows.
    """
    spark = edges.sparkSession
    high_low = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, path = durable_at(high_low.distinct(), "links")
    state, drop = None, []
    for _ in range(most_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, p1 = durable_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars, p2 = durable_at(larger.where("u <> v").distinct(), "stars")
        least, p3 = durable_at(stars.groupBy("u").agg(F.min("v").alias("m")), "least")
        smaller = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, p4 = durable_at(smaller.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (path, p1, p2, p3):
            remove(spark, old)
        now, path = after, p4
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
