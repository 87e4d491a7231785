import lzma
import math

import pytest
from pyspark.sql import functions as F

from prosegauge.plans import scoring


@pytest.fixture(scope="module")
def scored(spark):
    def run(*texts, seed=b""):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return [r.asDict(recursive=True) for r in scoring.score(df, seed).orderBy("doc_id").collect()]

    return run


def test_empty_and_null(scored):
    for r in scored("", None, "word"):
        assert r["score"] == 0 and r["label"] == "CLEAN"
        assert all(r[c]["raw"] == 0 and r[c]["hits"] == [] for c in scoring.MODULES)


def test_one_text(spark, scored):
    text = "We delve deep. In conclusion, we leverage synergy."
    (r,) = scored(text)
    assert scoring.analyze(spark, text) == {k: v for k, v in r.items() if k not in ("doc_id", "text")}
    assert scoring.analyze(spark, None)["label"] == "CLEAN"


def test_vocabulary(scored):
    (r,) = scored("We delve deep and leveraging robust,\na cutting edge feature of marked things")
    assert r["vocabulary"]["hits"] == [
        '  Line 1: "...We DELVE deep and leveraging robust,..." [delve]',
        '  Line 1: "...We delve deep and LEVERAGING robust,..." [leverage]',
        '  Line 1: "...We delve deep and leveraging robust,..." [robust]',
        '  Line 2: "cutting edge" [adjectives]',
    ]
    assert r["vocabulary"]["raw"] == 1.0


def test_phrases(scored):
    (r,) = scored("In conclusion, in conclusion it ends. Furthermore we stop here now.")
    assert r["phrases"]["hits"] == ['  Line 1: "In conclusion, in conclusion it e..." [closing]', '  Line 1: "in conclusion it ends. Furthermor..." [closing]', '  Line 1: starts with "furthermore" [transition]']


def test_rhythm_gate_and_value(scored):
    even = "One two three four. " * 10
    nine, ten, mixed = scored("One two three four. " * 9, even, "".join(f"{'Word ' * n}end. " for n in (1, 9, 2, 8, 3, 7, 1, 12, 2, 15)))
    assert nine["sentence_rhythm"] == {"hits": [], "raw": 0.0}
    assert ten["sentence_rhythm"]["raw"] == 1.0 and "CV=0.00 (very low)" in ten["sentence_rhythm"]["hits"][0]
    sizes = [n + 1 for n in (1, 9, 2, 8, 3, 7, 1, 12, 2, 15)]
    mean = sum(sizes) / 10
    cv = math.sqrt(sum((x - mean) ** 2 for x in sizes) / 9) / mean
    assert mixed["sentence_rhythm"]["raw"] == pytest.approx(max(0, min(1, (0.7 - cv) / 0.4)))


def test_punctuation(scored):
    few, same, varied = scored("." * 9, "." * 10, ".,;:!?" * 2)
    assert few["punctuation"]["raw"] == 0 and same["punctuation"]["raw"] == 1.0
    assert varied["punctuation"] == {"hits": [], "raw": 0.0}


def test_structure_runs(scored):
    (r,) = scored("Rivers run. Rivers bend. Rivers dry.")
    assert any("anaphora — 3 sentences" in h for h in r["structure"]["hits"]) and any("Sentences 1-3: 3 consecutive" in h for h in r["structure"]["hits"])
    two, skipped = scored("Rivers run. Rivers bend. Hills stay.", "The run. The bend. The dry.")
    assert not any("anaphora" in h for h in two["structure"]["hits"] + skipped["structure"]["hits"])


def test_burstiness_forms_agree(spark):
    from prosegauge.functions import segments as seg
    from prosegauge.operators import burstiness

    text = "window door garden window lamp door window garden door lamp garden " * 6
    df = seg.segment(spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string"))
    fold = {r[0]: r[1] for r in df.select("doc_id", burstiness.burstiness()).collect()}
    rows = {r[0]: r[1] for r in burstiness.by_window(df.select("doc_id", "tokens")).collect()}
    assert fold[2] is None and set(rows) == {1} and fold[1] == pytest.approx(rows[1])


def test_compression(scored):
    seed = "the quick brown fox jumps over the lazy dog and runs away ".encode() * 20
    same, short, other = scored(seed.decode()[:400], "x" * 99, "".join(chr(33 + i * 7 % 90) for i in range(300)), seed=seed)
    raw = seed.decode()[:400].encode()
    sim = 1 - (len(lzma.compress(seed + raw)) - len(lzma.compress(seed))) / len(lzma.compress(raw))
    assert same["compression"]["raw"] == pytest.approx(max(0, min(1, (sim - 0.3) / 0.2)))
    assert short["compression"]["raw"] == 0
    assert scored(seed.decode())[0]["compression"]["raw"] == 0


def test_rounding_and_labels(spark):
    got = [r[0] for r in spark.createDataFrame([(0.125,), (0.135,), (0.2,), (0.205,), (2.0,), (-1.0,)], "x double").select(scoring.rounded(F.col("x"))).collect()]
    assert got == [12, round(13.5), 20, round(0.205 * 100), 100, 0]
    labels = [r[0] for r in spark.createDataFrame([(n,) for n in (20, 21, 40, 41, 60, 61, 80, 81)], "n int").select(scoring.label(F.col("n"))).collect()]
    assert labels == ["CLEAN", "MILD", "MILD", "NOTICEABLE", "NOTICEABLE", "OBVIOUS", "OBVIOUS", "BLATANT"]


def test_raws_equal_scores(spark):
    from prosegauge.plans.planted import PLANTS

    df = spark.createDataFrame([(i, p * 3) for i, p in enumerate(PLANTS)], "doc_id long, text string")
    a = {r["doc_id"]: r for r in scoring.score(df).collect()}
    for r in scoring.raws(df).collect():
        assert r["score"] == a[r["doc_id"]]["score"]
        for c in scoring.MODULES:
            assert r[c]["raw"] == pytest.approx(a[r["doc_id"]][c]["raw"]) and 0 <= r[c]["raw"] <= 1
