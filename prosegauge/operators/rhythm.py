"""Variation of sentence lengths.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import segments as seg

LEAST_SENTENCES = 10


def variation() -> Column:
    """Coefficient of variation of sentence lengths; null for fewer than ten sentences."""
    sizes = F.col("sent_words")
    return F.when(F.size("sents") >= LEAST_SENTENCES, F.try_divide(seg.sample_std(sizes), seg.mean(sizes)))


def signals() -> dict[str, Column]:
    return {"rh_cv": variation()}


def raw() -> Column:
    return F.when(F.col("rh_cv").isNotNull(), seg.clamp((0.70 - F.col("rh_cv")) / (0.70 - 0.30))).otherwise(0.0)


def check() -> Column:
    cv = F.col("rh_cv")
    hit = lambda how, why: F.array(F.concat(F.lit("  Sentence rhythm: CV="), seg.fixed(cv, 2), F.lit(f" ({how}) — sentence lengths {why}")))
    return seg.check(F.when(cv < 0.35, hit("very low", "are unnaturally uniform")).when(cv < 0.50, hit("low", "lack natural variation")), raw())
