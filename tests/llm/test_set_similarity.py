"""Near-duplicates by Jaccard similarity against all pairs."""

import random

import pytest

from prosegauge.llm import set_similarity, simhash


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups_of(texts):
    """The least index of each text's component, by all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def planted(seed=5):
    """Copies with one to nine words changed, at both sides of the threshold, a common passage, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choices(words, k=40))
    texts = []
    for k in range(12):
        base = rng.choices(words, k=rng.randrange(60, 200))
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(n):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + (" " + passage if k % 3 == 0 else ""))
    texts += [f"{passage} {' '.join(rng.choices(words, k=rng.randrange(3, 30)))}" for _ in range(40)]
    return [*texts, texts[0].upper(), "", None, " ", "A b", "a  B", "x " * 3000, "x " * 50]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")


def test_every_pair_is_found(spark, rows):
    got = {r["doc_id"]: r["component_id"] for r in set_similarity.near_duplicates(rows).collect()}
    want = groups_of(planted())
    assert got == dict(enumerate(want)) and 20 < len(set(want)) < len(want) - 20
    kept = simhash.keep_one(rows, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.keep_one(rows.limit(0), similarity=0.8).count() == 0


def test_pipeline_stage_drops_near_copies(spark, rows):
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups_of(planted())))
