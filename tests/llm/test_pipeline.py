"""The stages one by one against plain versions, over planted, odd and empty rows, and as a whole."""

import random

import pytest

import corpus_pipeline
from prosegauge.llm import pii, quality_model, toxicity
from prosegauge.llm.common import read_table
from tests.conftest import DATA
from tests.llm.test_set_similarity import groups_of
from tests.llm.test_text_operators import base_spans, ids

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid int, root string, g map<string,int>"


def make(spark, texts):
    """Rows of the texts with columns whose names the operators use inside; a repeated row, and rows without doc_id."""
    rows = [(i, t, "en", "a", None if t is None else len(t), i, "r", {"k": i}) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, None, None, None)], COLUMNS)


def planted(seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60, 120))) + "." for _ in range(30)]
    near = texts[3].split()
    near[10] = "other"
    texts += [" ".join(near), texts[4].upper(), texts[5] + " you stupid idiot moron " * 9, "$$ ## %% || " * 60, "x " * 30_000, "", None, " ", f"mail a.b@c.de or +1 (988) 555-2485 {texts[6]}"]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, planted())


def kept(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def test_toxicity_stage(spark, odd):
    out = corpus_pipeline.drop_toxic(spark, odd, DATA)
    model = toxicity.learn(odd, read_table(spark, DATA, "labels"))
    assert out.columns == odd.columns and kept(out) == kept(odd.where(odd["doc_id"].isNull() | ~odd["doc_id"].isin([r["doc_id"] for r in odd.collect() if r["doc_id"] is not None and model.score(r["text"] or "") >= toxicity.THRESHOLD])))
    gone = set(kept(odd)) - set(kept(out))
    assert 32 in gone and not gone & set(range(30))  # row 32 is full of insults


def test_quality_stage(spark, odd):
    out = corpus_pipeline.drop_poor(spark, odd, DATA)
    model = quality_model.learn(odd, read_table(spark, DATA, "labels"))
    import numpy as np

    rows = odd.collect()
    scores = model.scores(np.array([quality_model.features(r["text"] or "") for r in rows]))
    want = [r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= quality_model.THRESHOLD]
    assert out.columns == odd.columns and kept(out) == sorted(want, key=lambda x: (x is None, x))


def test_near_duplicate_stage(spark, odd):
    out = corpus_pipeline.drop_near_duplicates(spark, odd, DATA)
    want = set(groups_of(planted()))
    assert out.columns == odd.columns and kept(out) == [*sorted(want), None]
    assert 30 not in want and 31 not in want  # the near copy and the copy in capitals


def test_personal_data_stage(spark, odd):
    out = corpus_pipeline.mask_personal_data(spark, odd, DATA)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(planted()):
        if not base_spans(t):
            assert got[i]["text"] == t and got[i]["g"] == {"k": i}
    assert got[38]["text"].startswith("mail <EMAIL> or <PHONE> ") and got[38]["n_chars"] == len(got[38]["text"])


def test_packing_stage(spark, odd):
    found = corpus_pipeline.pack(spark, odd, DATA).toPandas()
    for d, t in enumerate(planted()):
        assert found[found["doc_id"] == d]["length"].sum() == (len(ids(t)) + 1) * (2 if d == 0 else 1)  # the first row is there twice


def test_whole_run(spark):
    """Every stage's rows over its predecessor's, and a result over the whole."""
    out = corpus_pipeline.run(spark, DATA)
    docs = read_table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = out.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in tokens} == {d: len(ids(t)) + 1 for d, t in rows.items()}
    assert not any(base_spans(t) for t in rows.values()) and len(rows) < read_table(spark, DATA, "documents").count()


def test_empty_tables(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0
    assert pii.find(docs).count() == 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_duplicates", "personal_data", "packing"]
