"""Odd rows and columns, sessions elsewhere, and what an operator leaves behind."""

import math
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from prosegauge.llm import common, simhash, toxicity, vectors

REPO = Path(__file__).resolve().parents[2]


def test_keep_one_loses_no_text(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    rows = [(1, long[0], {"a": 1}), (1, long[1], None), (2, long[0], {"a": 2}), (3, long[2], None), (3, long[2], None), (None, long[0], None), (None, None, None), (4, None, None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g map<string,int>")
    for similarity in (None, 0.8):
        kept = simhash.keep_one(df, similarity)
        assert kept.columns == df.columns
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert got == sorted([(1, long[0]), (1, long[1]), (3, long[2]), (4, None), (None, long[0]), (None, None)], key=str)


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n is not None else None for n in (5, 5, 100, None, 1, 1, 1)]), pa.array(range(7))], ["text", "i"])
    assert [s.num_rows for s in common.slices(batch, 3, 10)] == [2, 1, 3, 1]
    assert [i for s in common.slices(batch, 2, 10**9) for i in s.column("i").to_pylist()] == list(range(7))
    assert [s.num_rows for s in common.slices(batch.slice(0, 0))] == [0]


def test_codec_follows_the_size_of_its_memo():
    assert common.library_codec(None, 50).cache.limit == 50 and common.library_codec(None, 60).cache.limit == 60
    assert common.library_codec(None, 60) is common.library_codec(None, 60)


def test_weight_is_nearly_linear_and_exact():
    model = toxicity.Model(words={"trash": 2.0, "clown": 1.0})
    began = time.perf_counter()
    assert model.weight("trash can " * 30_000)[0] == 0
    assert time.perf_counter() - began < 3
    assert model.weight("trash trash can clown fish clown trash bin trash")[0] == 5.0
    assert model.weight("")[0] == 0 and math.isfinite(model.feature(""))


def test_tiny_and_huge_vectors(spark):
    base = np.array([1.0, 2.0, 3.0])
    rows = [(0, base.tolist()), (1, (base * 2.0**-700).tolist()), (2, (base * 2.0**1000).tolist()), (3, [5e-324, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1e-200, 0.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_tiles_meet_whatever_their_size(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    v = np.concatenate([base + rng.normal(size=base.shape) * 0.05 for _ in range(12)])
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.98).sum(1) - 1).tolist()
    for tile in (4, 64):
        assert [r["n_links"] for r in vectors.near_duplicates(df, tile=tile).orderBy("vec_id").collect()] == want


def test_shared_folder_must_be_named_off_one_machine():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
if {step} == 0:
    from prosegauge.llm.token_files import write_token_files
    write_token_files(spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"), {out!r})
if {step} == 1:
    from prosegauge.llm.token_files import read_token_files
    print("READ", read_token_files(spark, {out!r}).count())
if {step} == 2:
    from prosegauge.functions.register import register
    register(spark)
    print("READ", spark.sql("select style_normalize('ab')").first()[0])
if {step} == 3:
    from prosegauge.functions import segments
    print("READ", spark.range(1).select(segments.normalize(F.lit("\\u0430"))).first()[0])
if {step} == 4:
    from prosegauge.llm import bpe
    print("READ", bpe.decode(spark.createDataFrame([(1, [300, 400])], "doc_id long, ids array<int>")).count())
if {step} == 5:
    from prosegauge.llm import html_main
    print("READ", html_main.differences(html_main.parse(spark.createDataFrame([(1, "http://a/b", "<p>x")], "page_id long, url string, html string"))).count())
usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
assert usual == "10000", usual
"""


def test_public_functions_in_new_sessions_elsewhere(tmp_path):
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for step, want in enumerate([None, "2", "ab", "a", "1", "0"]):
        code = ELSEWHERE.format(repo=str(REPO), step=step, out=str(tmp_path / "files"))
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
        assert want is None or f"READ {want}" in done.stdout
