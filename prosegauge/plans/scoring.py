"""The ten checks of every row, their weighted score and its label.

One scan, row-local expressions in three selects (segments, signals, checks), no
shuffle. Only normalisation and, where a seed is given, compression leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions.segments import segment
from prosegauge.functions.ship import ship
from prosegauge.operators import burstiness, compression, connectives, formatting, phrases, punctuation, rhythm, structure, tone, vocabulary

MODULES = {"vocabulary": vocabulary, "phrases": phrases, "structure": structure, "formatting": formatting, "tone": tone, "compression": compression, "sentence_rhythm": rhythm, "punctuation": punctuation, "connectives": connectives, "burstiness": burstiness}


def prepared(docs: DataFrame, seed: bytes = b"", text: str = "text", native: bool = False) -> DataFrame:
    """``docs`` with segments and signals."""
    ship(docs.sparkSession)
    df = tone.signals(segment(docs, text, native)).withColumns(structure.first_signals()).withColumns(vocabulary.signals() | structure.signals() | rhythm.signals() | burstiness.signals())
    for step in [*punctuation.signals(), *connectives.signals()]:
        df = df.withColumns(step)
    return df.withColumn("similarity", compression.similarity(F.col("t"), seed) if seed else F.lit(None).cast("double"))


def total() -> Column:
    """The weighted sum of the raw scores, added in the order of the weights so that doubles agree."""
    out = None
    for name, weight in lex.WEIGHTS.items():
        term = F.col(name)["raw"] * weight
        out = F.lit(0.0) + term if out is None else out + term
    return out


def rounded(total: Column) -> Column:
    """0 to 100, half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(total * 100).cast("int")))


def label(score: Column) -> Column:
    return F.when(score <= 20, "CLEAN").when(score <= 40, "MILD").when(score <= 60, "NOTICEABLE").when(score <= 80, "OBVIOUS").otherwise("BLATANT")


def score(docs: DataFrame, seed: bytes = b"", text: str = "text", native: bool = False) -> DataFrame:
    """``docs`` with a struct (hits, raw) for each check, ``score`` and ``label``."""
    df = prepared(docs, seed, text, native).select(*docs.columns, *[m.check().alias(name) for name, m in MODULES.items()])
    return df.withColumn("score", rounded(total())).withColumn("label", label(F.col("score")))


def analyze(spark: SparkSession, text: str | None, seed: bytes = b"") -> dict:
    """One text's checks (hits and raw score of each), score and label."""
    row = score(spark.createDataFrame([(text,)], "text string"), seed).first().asDict(recursive=True)
    return {k: v for k, v in row.items() if k != "text"}


def raws(docs: DataFrame, seed: bytes = b"", text: str = "text", native: bool = False) -> DataFrame:
    """The raw scores alone, without the evidence: the fast path for scores and labels."""
    df = prepared(docs, seed, text, native)
    counted = {"vocabulary": vocabulary.raw(), "phrases": phrases.raw()}
    cols = [F.struct((counted.get(name) if name in counted else m.raw()).cast("double").alias("raw")).alias(name) for name, m in MODULES.items()]
    df = df.select(*docs.columns, *cols)
    return df.withColumn("score", rounded(total())).withColumn("label", label(F.col("score")))
