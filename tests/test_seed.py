"""The compression check's seed holds every text or is refused."""

import lzma

import pytest

from prosegauge.operators import compression
from prosegauge.plans.catalog import QUERIES


def test_seed_holds_every_text(spark, tmp_path):
    items = [(i, f"item {i} " + " ".join(str(i * k * 7919) for k in range(60))) for i in range(60)]
    table = spark.createDataFrame(items[::-1], "item_id long, text string")
    whole = "\n".join(t for _, t in items).encode()
    assert len(whole) > 10_000 and compression.seed_corpus(table) == whole == compression.seed_corpus(table, len(whole))
    with pytest.raises(ValueError):
        compression.seed_corpus(table, len(whole) - 1)
    assert compression.seed_corpus(table.limit(0)) == b""
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    raw = items[-1][1].encode()
    spark.createDataFrame([(1, raw.decode(), "en", "a", len(raw))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["compression_similarity"](spark, str(tmp_path)).first()
    text = spark.read.parquet(f"{tmp_path}/documents.parquet")
    from prosegauge.functions import segments as seg
    from prosegauge.plans.planted import planted

    t = text.select(seg.normalize(planted(key="doc_id")).alias("t")).first()["t"].encode()
    want = 1 - (len(lzma.compress(whole + t)) - len(lzma.compress(whole))) / len(lzma.compress(t))
    assert got["similarity"] == pytest.approx(want)
