"""Operators on single texts and their tables against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegauge.llm import bpe, common, html_main, packing, pii, quality_model, quality_rules, simhash, token_files, toxicity
from prosegauge.llm.components import connected_components, forest

ODD = ["", None, " ", "\n\n", "word", "Same text here. " * 40, "Same text here. " * 40, "x" * 30_000, "a " * 20_000, "É é ß 日本 \x1c\x85 👍🏽", "<|endoftext|> a<|startoftext|>", "don't 's 'LL 1234 ²³"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and columns with clashing names."""
    rows = [(i, t, "en", "a", len(t or ""), 1, "b") for i, t in enumerate(ODD)] + [(5, ODD[5], "en", "a", 640, 1, "b"), (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, root string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.vocabulary_path())


TOKENIZER = library()


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs", "Cn"]), max_size=60), max_size=4))
def test_both_codecs_equal_the_library(texts):
    for codec in (bpe.codec(), common.library_codec(None)):
        assert [x.tolist() for x in codec.encode_each(pa.array(texts, pa.string()))] == [ids(t) for t in texts]


def test_small_caches_change_nothing():
    texts = [t or "" for t in ODD] + [" ".join(f"w{i}x" for i in range(3000))]
    for codec in (bpe.PairIndexCodec(common.vocabulary_path(), 10), common.LibraryCodec(common.vocabulary_path(), 10)):
        assert [x.tolist() for x in codec.encode_each(pa.array(texts * 2))] == [ids(t) for t in texts * 2]


def test_bpe_digests(spark, odd):
    rows = bpe.digests(odd).collect()
    assert len(rows) == odd.count()
    want = Counter((t["doc_id"], len(i := ids(t["text"])), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(TOKENIZER.decode(i, skip_special_tokens=False).encode()).hexdigest()) for t in odd.collect())
    assert Counter(map(tuple, rows)) == want
    back = bpe.decode(bpe.encode(odd.where("doc_id = 10"))).first()
    assert back["text"] == TOKENIZER.decode(ids(ODD[10]), skip_special_tokens=False)
    assert bpe.digests(odd.limit(0)).count() == 0


def test_packing(spark, odd):
    found = packing.pack_documents(odd, piece=50, capacity=256).toPandas()
    for _, seq in found.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.cumsum(seq["length"]) - seq["length"]).all() and seq["length"].sum() <= 256
    total = sum(len(ids(r["text"])) + 1 for r in odd.collect())
    assert found["length"].sum() == total
    raw = np.array([*ids(ODD[11]), 1], "<u4")
    for r in found[found["doc_id"] == 11].itertuples():
        assert r.ids_crc32 == zlib.crc32(raw[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(raw)
    assert packing.pack_documents(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=120), st.integers(400, 900))
def test_differencing(sizes, capacity):
    window = packing.pack(sizes, capacity)
    assert len(window) == len(sizes)
    if sizes:
        assert np.bincount(window, weights=sizes).max() <= capacity


def test_differencing_balances():
    sizes = random.Random(0).choices(range(50, 400), k=2000)
    sums = np.bincount(packing.difference(sizes, 200), weights=sizes, minlength=200)
    assert sums.max() - sums.min() < 40


def test_token_files(spark, odd, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "t"), block_ids=500)
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: (d is not None, d))
    at = 0
    by = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        assert r["start"] == at and r["ids"] == [*ids(by[r["doc_id"]]), 2] and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert token_files.round_trip(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300))
def test_code_lengths(counts):
    import heapq

    counts = np.array(counts)
    lengths = token_files.code_lengths(counts).astype(int)
    used = counts > 0
    assert (lengths[used] > 0).all() and not lengths[~used].any() and (0.5 ** lengths[used]).sum() <= 1
    heap = [(int(c), 0) for c in counts[used]]
    if len(heap) > 1 and lengths.max() < token_files.LONGEST:  # unlimited Huffman costs the same
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            cost += a + b
            heapq.heappush(heap, (a + b, 0))
        assert cost == int((counts * lengths).sum())


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    known = dict(forest(links))
    return {n: known.get(n, n) for n in nodes}


def test_simhash(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=120) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for n in (1, 1, 2, 3):
            copy = list(b)
            for _ in range(n):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [*texts[:5], "", None, "A b", "a B"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, root long")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = roots(range(len(fps)), links)
    assert got == {i: (fps[i], want[i]) for i in want}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_ball_variants_meet_at_every_distance():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for k in rng.integers(1, 6, 20):
            x = int(b)
            for i in rng.choice(64, k, replace=False):
                x ^= 1 << int(i)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    batches = list(simhash._variants(iter([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])]), 5))
    keys = np.concatenate([np.frombuffer(v, np.uint64) for b in batches for v in b.column("variants").to_pylist()])
    codes = np.concatenate([np.frombuffer(v, np.uint16) for b in batches for v in b.column("codes").to_pylist()])
    close = np.bitwise_count(fps[:, None] ^ fps) <= 3
    links = [(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True)]
    assert roots(map(int, fps), simhash.meet(keys, codes).tolist()) == roots(map(int, fps), links)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, 500), (700, 600)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: r for n, r in roots({x for e in links if e[0] != e[1] for x in e}, links).items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules(spark, odd):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(ODD):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        seen, repeated = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert [by[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), repeated, len(covered), failed]
        assert not (failed and by[i]["kept"])
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_quality_rules_reject_noise(spark):
    rng = random.Random(2)
    common = quality_rules.COMMON_WORDS["en"]
    clean = [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(30)]
    noisy = [" ".join(w + "$$$" for w in t.split()) for t in clean[:2]] + [t.upper() for t in clean[2:4]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + noisy)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(30))


LUHN = "4041894974608795"
PRIVATE = f"Mail a.b@c.de, x@y, z@q.r.s. IPs 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5. Card {LUHN} or 4041 8949 7460 8795, not 4041894974608796. Call +1 (988) 555-2485 or +12. é a@b.c%d@e.f"


def base_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark, odd):
    long = "1-2 " * 4000 + "a." * 3000 + "@" + "b." * 3000 + "c" + "+1" + " 2" * 5000
    rows = [(20, PRIVATE, "en", "a", 1, 1, "b"), (21, long, "en", "a", 1, 1, "b"), (22, "1 " * 3000, "en", "a", 1, 1, "b")]
    df = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    got = pii.find(df).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in got}
    for r in df.collect():
        want = base_spans(r["text"])
        assert by[r["doc_id"]]["base"] == ",".join(want) and by[r["doc_id"]]["n_email"] == sum(w.startswith("email") for w in want)
    assert pii.find(df.limit(0)).count() == 0
    masked = {r["doc_id"]: r for r in pii.mask(df).collect()}
    assert masked[20]["text"].startswith("Mail <EMAIL>, x@y, <EMAIL>. IPs <IP> and 300.1.1.1") and masked[20]["n_chars"] == len(masked[20]["text"])
    assert LUHN not in masked[20]["text"] and masked[4]["text"] == "word" and masked[1]["text"] is None


def test_pii_discovers_by_context(spark):
    texts = [f"please call me at +1 (988) 555-{1000 + i} today" for i in range(12)] + ["please call me at 988-555-7777 today", "about the year 1984 or 12345678 alone"]
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    start = texts[12].index("988")
    assert rows[12]["spans"] == f"phone:{start}:{start + 12}" and rows[12]["base"] == "" and rows[13]["spans"] == ""


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><header><h1>T &amp; t</h1></header>
<p>a <b>b</b>c<br>d<p>e &am f &amp<div class="comments"><p>no</p></div><script>var t="</p>";</script><p>z\xa0 y</article><footer>&copy; f</footer></body></html>"""


def test_html(spark):
    plain = lambda n: f"<body><div>Site name</div><p>Own line {n} &lt;x&gt;</p><p>More {n}</p><div>Imprint here</div></body>"
    rows = [(1, "http://h.x/a/1", PAGE), (2, "http://p.x/a/1", plain(1)), (3, "http://p.x/a/2", plain(2)), (4, "http://p.x/a/2", plain(2)), (5, "http://lone.x/", plain(5)), (6, None, None), (7, "http://[bad", ""), (8, "http://p.x/b/9", plain(9))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, k string")
    got = {r["page_id"]: r["text"] for r in html_main.main_text(df).collect()}
    assert got == {1: "T & t a bc d e &am f & z y", 2: "Own line 1 <x> More 1", 3: "Own line 2 <x> More 2", 4: "Own line 2 <x> More 2", 5: "Site name Own line 5 <x> More 5 Imprint here", 6: "", 7: "", 8: "Own line 9 <x> More 9"}
    assert html_main.main_text(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    common_ = [x for x, s in zip(a, html_main.shared_lines(a, b), strict=True) if s]
    rest = iter(b)
    assert len(common_) == table[-1][-1] and all(x in rest for x in common_)


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    docs = [(i, " ".join(rng.choices(words, k=40) + ([rng.choice(["blargo", "zunkel"]), "idiot"] if i % 4 == 0 else []))) for i in range(240)]
    df = spark.createDataFrame([*docs, (900, ""), (901, None), (902, "such a bl4rgo"), (903, "put it in the trash can please")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(200, 240))
    assert max(got[900], got[901], got[903]) < 0.3 <= got[902]
    empty = labels.limit(0)
    assert toxicity.learn(df, empty).score("you idiot") > 0.3
    assert toxicity.remove_toxic(df, model).where("doc_id = 0").count() == 0


def test_folding():
    assert toxicity.fold("ІDI0T, m0r0n! $cum l​oser 1d1ot").split() == ["idiot", "moron", "cum", "loser", "idiot"]
    assert toxicity.Model(words={"scum": 3.0}).weight("a s$um scum $cum")[0] == 3.0


def test_quality_model(spark):
    rng = random.Random(6)
    text = lambda noisy: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) + ("$$$" if noisy else "") for _ in range(60))
    df = spark.createDataFrame([(i, text(i % 5 == 0)) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(250)] + [(7, None), (None, 0)], "doc_id long, quality int")
    model = quality_model.learn(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 > 0) for i in range(250, 300)) and all(0 <= s <= 1 for s in got.values())
    unknown = quality_model.learn(df, labels.limit(0))
    assert quality_model.score(df, unknown).where("score < 0.99").count() == 0
    assert quality_model.remove_poor(df, model).where("doc_id = 0").count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_model.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
