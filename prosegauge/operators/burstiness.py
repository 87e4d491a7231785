"""How evenly content words are spread: variation of the gaps between their occurrences.

The row-local form is the default: a text's own tokens are sorted with their
places, so equal words lie together and one fold sees all gaps, without a
shuffle. ``by_window`` is the relational form over exploded rows.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg

LEAST_TOKENS, LEAST_LENGTH, LEAST_OCCURRENCES = 50, 5, 3


def burstiness() -> Column:
    """Mean over words of the gaps' coefficient of variation; null for short texts or without such words."""
    placed = F.transform("tokens", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    content = F.array_sort(F.filter(placed, lambda x: (F.length(x["w"]) >= LEAST_LENGTH) & ~x["w"].isin(lex.BURSTINESS_STOPWORDS)))
    zero = F.struct(F.lit("").alias("w"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("total"), F.lit(0).alias("words"))

    def cv(a: Column) -> Column:  # of n gaps with sum s and sum of squares q
        mean = a["s"] / a["n"]
        return F.sqrt(F.greatest(F.lit(0.0), (a["q"] - a["n"] * mean * mean) / (a["n"] - 1))) / mean

    def closed(a: Column) -> tuple[Column, Column]:
        enough = a["n"] >= LEAST_OCCURRENCES - 1
        return F.when(enough, a["total"] + cv(a)).otherwise(a["total"]), F.when(enough, a["words"] + 1).otherwise(a["words"])

    def step(a: Column, x: Column) -> Column:
        gap = (x["i"] - a["i"]).cast("double")
        total, words = closed(a)
        same = F.struct(x["w"].alias("w"), x["i"].alias("i"), (a["n"] + 1).alias("n"), (a["s"] + gap).alias("s"), (a["q"] + gap * gap).alias("q"), a["total"].alias("total"), a["words"].alias("words"))
        other = F.struct(x["w"].alias("w"), x["i"].alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), total.alias("total"), words.alias("words"))
        return F.when(a["w"] == x["w"], same).otherwise(other)

    return F.when(F.size("tokens") >= LEAST_TOKENS, F.aggregate(content, zero, step, lambda a: F.try_divide(closed(a)[0], closed(a)[1])))


def signals() -> dict[str, Column]:
    return {"bu_mean": burstiness()}


def by_window(segmented: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for rows ``key, tokens``: a window over occurrences, then two aggregations.

    Short texts drop out after the outer generator: a test of ``tokens`` before it
    would be evaluated a second time wherever Spark pushes it.
    """
    rows = segmented.select(key, F.posexplode_outer(F.when(F.size("tokens") >= LEAST_TOKENS, F.col("tokens"))).alias("pos", "w"))
    rows = rows.where(F.col("w").isNotNull() & (F.length("w") >= LEAST_LENGTH) & ~F.col("w").isin(lex.BURSTINESS_STOPWORDS))
    gaps = rows.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy(key, "w").orderBy("pos")))
    words = gaps.groupBy(key, "w").agg((F.stddev_samp("gap") / F.avg("gap")).alias("cv"), F.count("gap").alias("n")).where(f"n >= {LEAST_OCCURRENCES - 1}")
    return words.groupBy(key).agg(F.avg("cv").alias("burstiness"))


def raw() -> Column:
    return F.when(F.col("bu_mean").isNotNull(), seg.clamp((1.0 - F.col("bu_mean")) / 0.7)).otherwise(0.0)


def check() -> Column:
    b = F.col("bu_mean")
    hit = lambda how, why: F.array(F.concat(F.lit("  Word burstiness: "), seg.fixed(b, 2), F.lit(f" ({how}) — content words {why}")))
    return seg.check(F.when(b < 0.5, hit("very low", "are distributed too evenly")).when(b < 0.7, hit("low", "lack natural clustering")), raw())
