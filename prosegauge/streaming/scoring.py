"""Scoring of a stream: the checks are row-local, so the batch plan runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.plans.scoring import raws


def score_stream(docs: DataFrame, seed: bytes = b"") -> DataFrame:
    """``docs`` (streaming, with a column ``text``) with scores and labels; no state is kept."""
    return raws(docs, seed)


def label_counts(scored: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Labels by windows of event time; rows later than ``late`` are not waited for."""
    return scored.withWatermark(time, late).groupBy(F.window(time, width), "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
