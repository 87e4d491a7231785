"""What the opN_ queries return, through QUERIES, against plain versions over the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from prosegauge.llm import pii, quality_model, toxicity
from prosegauge.llm.components import forest
from prosegauge.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_text_operators import TOKENIZER, base_spans, brute_fingerprint, ids


def rows(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, DATA).collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op2(spark, docs):
    found = QUERIES["op2_packing"](spark, DATA).toPandas()
    want = {d: [*ids(t), 1] for d, t in docs.items()}
    for d, pieces in found.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert pieces["start"].tolist() == (np.cumsum(pieces["length"]) - pieces["length"]).tolist()
        for r in pieces.itertuples():
            assert r.ids_crc32 == crc(want[d][r.start : r.start + r.length]) and r.doc_tokens == len(want[d])
        assert pieces["length"].sum() == len(want[d])
    assert set(found["doc_id"]) == set(docs)
    for _, seq in found.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == (np.cumsum(seq["length"]) - seq["length"]).tolist() and seq["length"].sum() <= 2048
    assert found["sequence_id"].nunique() <= 1.05 * found["length"].sum() / 2048 + 1


def test_op3(spark, docs):
    got, start = rows(spark, "op3_token_files"), 0
    assert len(got) == len(docs)
    for d in sorted(docs):
        want = [*ids(docs[d]), 2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(want), crc(want))
        start += len(want)


def test_op4(spark, docs):
    got = rows(spark, "op4_simhash")
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    known = dict(forest([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fps[d]:016x}", known.get(d, d)) for d in fps}


def test_op5(spark, docs):
    got = rows(spark, "op5_html_main")
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert got.keys() == pages.keys()
    assert all(r["url"] == pages[i]["url"] and r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for i, r in got.items())
    # each page's article is its title and the document that its URL names
    of = {i: docs.get(int(re.search(r"/(\d+)", pages[i]["url"].split("//")[1])[1])) for i in pages}
    told = [i for i in pages if of[i] is not None]
    assert told and all(got[i]["text"].endswith(" ".join(of[i].split())) for i in told)


def test_op6(spark):
    got = rows(spark, "op6_vectors")
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    n, links = {r["vec_id"]: 0 for r in vectors}, []
    usable = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in vectors if r["label"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    for i, a, la in usable:
        for j, b, lb in usable:
            if i != j and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                n[i] += 1
                links.append((i, j))
    known = dict(forest(links))
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], known.get(i, i), known.get(i, i) == i) for i in n}


@pytest.mark.parametrize(("name", "module", "mark", "folds", "held"), [("op7_quality_model", quality_model, "quality", 5, 0), ("op8_toxicity", toxicity, "toxic", 4, 2)])
def test_classifiers(spark, docs, name, module, mark, folds, held):
    """Folds, rounding to a prediction, the score of a model learnt apart from held-out labels, and held-out accuracy."""
    got = rows(spark, name)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = {d for d in docs if zlib.crc32(str(d).encode()) % folds == held}
    assert {d for d, r in got.items() if r["held_out"]} == out and got.keys() == docs.keys()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    kept = spark.createDataFrame([tuple(r) for r in labels.collect() if r["doc_id"] not in out], labels.schema)  # held-out labels are not even there
    model = module.learn(spark.read.parquet(f"{DATA}/documents.parquet"), kept)
    if name == "op8_toxicity":
        again = {d: model.score(t) for d, t in docs.items()}
    else:
        x = np.array([module.features(t) for t in docs.values()])
        total = np.full(len(x), model.intercept)
        for i, table in enumerate(model.tables):  # entry by entry
            total += [table[np.searchsorted(model.edges[i], v, "right")] for v in x[:, i]]
        for i, j, table in model.pairs:
            total += [table[np.searchsorted(model.edges[i], v, "right"), np.searchsorted(model.edges[j], w, "right")] for v, w in x[:, [i, j]]]
        again = dict(zip(docs, 1 / (1 + np.exp(-total)), strict=True))
    assert all(abs(got[d]["score"] - again[d]) < 1e-9 for d in docs)
    known = {r["doc_id"]: r[mark] for r in labels.collect() if r["doc_id"] in out and r[mark] is not None}
    assert np.mean([got[d]["predicted"] == y for d, y in known.items()]) >= 0.85


def test_op9(spark, docs):
    got = rows(spark, "op9_bpe_codec")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d, t in docs.items():
        own = ids(t)
        assert tuple(got[d]) == (d, len(own), sha(" ".join(map(str, own))), sha(TOKENIZER.decode(own, skip_special_tokens=False)))


def test_op10(spark, docs):
    got = rows(spark, "op10_pii")
    for d, t in docs.items():
        want = base_spans(t)
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [x for x in got[d]["spans"].split(",") if x]
        assert set(want) <= set(spans) and got[d]["n_discovered"] == len(spans) - len(want)
        place = lambda x: (pii.FOUND.index(x.split(":")[0]), *map(int, x.split(":")[1:]))
        assert spans == sorted(spans, key=place)


def test_fingerprints_are_of_bytes():
    assert brute_fingerprint("A b") == brute_fingerprint("a  B\n") != brute_fingerprint("É") and xxhash.xxh64_intdigest("a b", seed=42)
