"""Similarity to a seed corpus by compression: how little xz needs for a text after the seed.

Spark has no such primitive, so this is an Arrow UDF over xz, which reads the seed once for each
worker and not for each text (``xz_state``).
The seed is a parameter; without one the check gives 0.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

import lzma
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import segments as seg
from prosegauge.operators import xz_state

LEAST_BYTES, MOST_BYTES = 100, 1_000_000


@lru_cache(maxsize=2)
def sized(prefix: bytes) -> Callable[[bytes], int]:
    """The length of xz of ``prefix`` and a text, kept by each worker for the seed and for none."""
    return xz_state.sizer(prefix)


def similarity(text: Column, seed: bytes) -> Column:
    """Null for short texts; texts are cut at a million bytes."""
    alone = len(lzma.compress(seed)) if seed else 0

    @F.pandas_udf("double")
    def measured(s: pd.Series) -> pd.Series:
        def one(t: str) -> float | None:
            raw = (t or "").encode("utf-8", "surrogatepass")
            if not seed or len(raw) < LEAST_BYTES:
                return None
            raw = raw[:MOST_BYTES]
            return 1 - (sized(seed)(raw) - alone) / sized(b"")(raw)

        return s.map(one)

    return measured(text)


def seed_corpus(items: DataFrame, most_bytes: int = 1_000_000) -> bytes:
    """A seed from all texts of ``items(item_id, text)`` in order; it goes to every task, so more than ``most_bytes`` is an error."""
    parts, size = [], -1
    for r in items.orderBy("item_id").select("text").toLocalIterator():
        raw = (r["text"] or "").encode("utf-8", "surrogatepass")
        size += len(raw) + 1
        if size > most_bytes:
            raise ValueError(f"the seed's texts take more than {most_bytes} bytes")
        parts.append(raw)
    return b"\n".join(parts)


def raw() -> Column:
    return F.when(F.col("similarity").isNotNull(), seg.clamp((F.col("similarity") - 0.30) / 0.20)).otherwise(0.0)


def check() -> Column:
    """From a column ``similarity``."""
    s = F.col("similarity")
    hit = lambda how, why: F.array(F.concat(F.lit("  Compression similarity: "), seg.fixed(s, 3), F.lit(f" ({how}) — {why}")))
    return seg.check(F.when(s > 0.45, hit("high", "text compresses well against AI corpus")).when(s > 0.38, hit("moderate", "some pattern overlap with AI corpus")), raw())
