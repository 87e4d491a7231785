"""Variety of punctuation: entropy of its distribution against that of six kinds.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg

LEAST_MARKS = 10


def counts() -> Column:
    """How often each mark occurs, in the order of the list: replacements, so no explode and no shuffle."""
    return F.array(*[F.length("pu_marks") - F.length(F.replace(F.col("pu_marks"), F.lit(c), F.lit(""))) for c in lex.PUNCTUATION])


def marks() -> Column:
    return F.regexp_replace("t", "[^" + "".join("\\" + c for c in lex.PUNCTUATION) + "]", "")


def entropy() -> Column:
    """In bits, from the column of counts; null for fewer than ten marks."""
    shares = F.transform(F.filter("pu_counts", lambda x: x > 0), lambda x: x / F.col("pu_total"))
    return F.when(F.col("pu_total") >= LEAST_MARKS, -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p)))


def signals() -> list[dict[str, Column]]:
    """Columns in four steps, each read by the next more than once."""
    return [{"pu_marks": marks()}, {"pu_counts": counts()}, {"pu_total": F.aggregate("pu_counts", F.lit(0), lambda s, x: s + x)}, {"pu_entropy": entropy()}]


def raw() -> Column:
    return F.when(F.col("pu_entropy").isNotNull(), seg.clamp((0.60 - F.col("pu_entropy") / math.log2(6)) / (0.60 - 0.20))).otherwise(0.0)


def check() -> Column:
    share = F.col("pu_entropy") / math.log2(6)
    hit = lambda how, why: F.array(F.concat(F.lit("  Punctuation diversity: entropy="), seg.fixed(F.col("pu_entropy"), 2), F.lit(f" ({how}) — {why}")))
    return seg.check(F.when(share < 0.30, hit("very low", "almost only commas and periods")).when(share < 0.45, hit("low", "limited punctuation variety")), raw())
