"""The ``opN_<name>`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm.common import crc_bucket, read_table
from prosegauge.llm.sql import ORACLE_SQL as ORACLE_SQL


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.quality_rules import judge

    verdict = judge(read_table(spark, sf_dir, "documents"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.token_files import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.simhash import near_duplicates

    groups = near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.html_main import main_text

    found = main_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.vectors import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm import quality_model as q

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = crc_bucket("doc_id", 5) == 0
    scored = q.score(docs, q.learn(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= q.THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm import toxicity as t

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = crc_bucket("doc_id", 4) == 2
    scored = t.score(docs, t.learn(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= t.THRESHOLD).cast("int").alias("predicted"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.bpe import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosegauge.llm.pii import KINDS, find

    found = find(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_discovered")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op1_divergence,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_simhash": op4_simhash,
    "op5_html_main": op5_html_main,
    "op6_vectors": op6_vectors,
    "op7_quality_model": op7_quality_model,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_pii": op10_pii,
    "pipeline": pipeline,
}
