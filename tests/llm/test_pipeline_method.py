"""The pipeline's near-duplicate stage goes by op4's fingerprints before its shingles are compared."""

import random

import corpus_pipeline
from prosegauge.llm import set_similarity, simhash


def test_near_duplicates_go_by_fingerprints(spark, monkeypatch):
    """op4's fingerprints propose pairs, and a proposal stays only if it is similar enough."""
    loop, rng = "red green blue " * 400, random.Random(3)
    tail = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(40))
    base = " ".join(tail() for _ in range(30))
    texts = [loop + tail(), loop + tail(), base, base + " end", tail()]
    assert simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1])
    assert bin(simhash.fingerprint(texts[2]) ^ simhash.fingerprint(texts[3])).count("1") <= 3
    met, links = [], set_similarity._links

    def seen(pairs, sets, similarity, label):
        met.append({(r["a"], r["b"]) for r in pairs.collect()})
        return links(pairs, sets, similarity, label)

    proposals, proposed = [], simhash.proposed
    monkeypatch.setattr(simhash, "proposed", lambda ids: proposals.append(proposed(ids)) or proposals[-1])
    monkeypatch.setattr(set_similarity, "_links", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 4]
    pairs = {(r["a"], r["b"]) for r in proposals[0].collect()}
    assert len(pairs) == 2 and pairs <= met[0]
