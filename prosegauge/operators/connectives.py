"""Density of discourse connectives.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg


def found() -> Column:
    return F.filter("tokens", lambda w: w.isin(lex.CONNECTIVES))


def density() -> Column:
    """Connectives per hundred tokens; null for fewer than three sentences or no token."""
    return F.when(F.size("sents") >= 3, F.try_divide(F.size("co_found"), F.size("tokens") / 100))


def signals() -> list[dict[str, Column]]:
    return [{"co_found": found()}, {"co_density": density()}]


def examples() -> Column:
    return F.slice(F.array_distinct("co_found"), 1, 5)


def raw() -> Column:
    return F.when(F.col("co_density").isNotNull(), seg.clamp((F.col("co_density") - 0.5) / 3.0)).otherwise(0.0)


def check() -> Column:
    d = F.col("co_density")
    hit = lambda how: F.array(F.concat(F.lit("  Connective density: "), seg.fixed(d, 1), F.lit(f" per 100 words ({how}) — "), F.array_join(examples(), ", ")))
    return seg.check(F.when(d > 3.0, hit("high")).when(d > 1.5, hit("moderate")), raw())
