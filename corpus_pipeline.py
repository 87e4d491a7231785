"""A corpus pipeline of five of the training-data operators.

Toxic documents go, then poor ones, then near-duplicates but one of each group;
personal data is masked; what is left is packed into sequences. Both classifiers
learn from the labelled documents of the table at hand.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, whatever further columns there are. An empty table
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosegauge.llm import packing, pii, quality_model, simhash, toxicity
from prosegauge.llm.common import durable_at, read_table, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that the lexicon scores as toxic.

    Null, empty and wordless texts score as texts without a match; repeated rows and
    ties go or stay together; rows without doc_id are scored like any other, though
    no label is theirs. Without usable labels the built-in list decides.
    """
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that the additive model scores as poor.

    Null and empty texts have all features zero and are scored like any other;
    repeated rows and ties go or stay together. Without labels of both classes all stay.
    """
    model = quality_model.learn(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.remove_poor(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a Jaccard similarity of 0.8 of their 5-word shingles: that of the least doc_id.

    Wordless texts, null ones among them, are one group; rows that share a doc_id
    but not their text count each for itself; rows without doc_id stay. op4's own
    three bits of 64 would find little but exact copies, see ``simhash.keep_one``.
    """
    return simhash.keep_one(docs, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind, and n_chars renewed.

    Texts without a span, null and empty ones among them, stay as they are; repeated
    rows are masked alike.
    """
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``docs`` in sequences of 2048 tokens, as op2 returns them.

    Null and empty texts are one piece of one id; repeated rows have pieces each.
    """
    return packing.pack_documents(docs, memo=100_000, rows=1000)  # executors still hold what the stages before have used


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Trained models, components and tokenizers have no SQL; tests hold every stage and the whole run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; of the written tables the last stays."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = durable_at(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return docs
