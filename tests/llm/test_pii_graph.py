"""Bootstrapped extraction against a plain version of the whole operator, and identifiers planted behind known contexts."""

import random
import re
from collections import defaultdict

import pytest

from prosegauge.llm import pii
from tests.llm.test_text_operators import base_spans

ASCII = re.ASCII
BREAK = "\\s\"'(),;:!?<>\\[\\]{}|="
TOKEN = re.compile(rf"(?<![^{BREAK}])(?=[^{BREAK}0-9@]*[0-9@])[^{BREAK}]+", ASCII)
KINDS = ["email", "ip", "card", "phone", "secret"]


def pieces_before(text, n):
    """The last pieces of a text: runs without white space, and before them marks that touch the end."""
    out, rest = [], text[::-1]
    for _ in range(n):
        m = re.match(r"\s*[^\s\w]+(?=\w)|\s*\S+", rest, ASCII)
        if not m:
            break
        out.append(m[0])
        rest = rest[m.end() :]
    return ["".join(out[: k + 1])[::-1] for k in range(len(out))]


def plain(c):
    return re.sub(r"\s+", " ", re.sub("[0-9]", "0", c.lower()), flags=ASCII)


def contexts(text, s, e):
    left = [plain(x) for x in pieces_before(text[:s], 3)]
    m = re.match(r"\s*[^\s\w]+(?=\w)|\s*\S+", text[e:], ASCII)
    right = plain(m[0]) if m else ""
    left += [left[-1] if left else ""] * (3 - len(left))
    one, two, three = left
    out = [f"3:{three}"] * (three != two) + [f"2:{two}"] * (two != one)
    return out + ([f"1:{one}", f"b:{one}_{right}"] if one else [])


def shape(m):
    dotted = re.search(r"^[0-9]+(?:\.[0-9]+){3}$", m)
    kind = "@" if "@" in m else "0" if re.search("^[0-9]+$", m) else "0-" if re.search(r"^[+0-9][0-9() .\-]*$", m) and not dotted else "0." if re.search(r"^[0-9.]+$", m) else "w"
    return kind + "+" * (len(m) >= (16 if kind == "w" else 6))


def looks(m):
    n = len(re.sub("[^0-9]", "", m))
    tests = {
        "email": "@" in m,
        "ip": n >= 3 and re.search(r"^[0-9A-Fa-f.:]*[.:][0-9A-Fa-f]*[.:][0-9A-Fa-f.:]*$", m),
        "card": n >= 12 and re.search(r"^[0-9 \-]+$", m),
        "phone": 6 <= n <= 15 and re.search(r"^[+0-9 ().\-/]+$", m),
        "secret": len(m) >= 16 and n >= 1 and re.search("[A-Za-z]", m) and re.search(r"^[A-Za-z0-9+/_\-.~]+$", m),
    }
    return [k for k in KINDS if tests[k]]


def brute(texts):
    """The spans of every text, base and found."""
    base = [[(x.split(":")[0], *map(int, x.split(":")[1:])) for x in base_spans(t)] for t in texts]
    free = []
    for t, own in zip(texts, base, strict=True):
        found = []
        for m in TOKEN.finditer(t):
            # the base matches that begin before a token may reach into it, those after begin within it
            if any(s < m.end() and m.start() < e for _, s, e in own):
                continue
            word = re.sub(r"[.\-+*#$%&]+$", "", m[0])
            if word:
                found.append((m.start(), m.start() + len(word), word, m.end()))
        free.append(found)
    edges = {}  # (pattern, token, kind): [seed, base]
    for t, own, found in zip(texts, base, free, strict=True):
        for kind, s, e in own:
            for c in contexts(t, s, e):
                edges[c + "|" + shape(t[s:e].lower()), t[s:e].lower(), kind] = [True, True]
        for s, _, word, end in found:
            before = plain(t[:s])[-200:]
            key = re.search("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", word) and not re.search(r"\b(?:commit|revision|rev|sha|sha0+|md0|checksum|digest|etag|hash|blob|tree|fingerprint|uuid|guid)\W*$", before, ASCII)
            for c in contexts(t, s, end):
                for k in looks(word):
                    e = edges.setdefault((c + "|" + shape(word.lower()), word.lower(), k), [False, False])
                    e[0] |= bool(key and k == "secret")
    belief = {}
    for _ in range(pii.ROUNDS):
        by = defaultdict(list)
        for (p, m, k), (seed, is_base) in edges.items():
            b = belief.get((k, m), 0.0)
            by[p, k].append((1.0 if seed else 0.0 if is_base else b if b >= pii.CONFIDENCE else 0.0, is_base))
        firm = defaultdict(int)
        for (p, _), rows in by.items():
            firm[p] += sum(f for _, f in rows)
        trust = {}
        for (p, k), rows in by.items():
            if sum(w >= pii.CONFIDENCE for w, _ in rows) >= pii.LEAST_SEEDS:
                trust[p, k] = sum(w for w, _ in rows) / (len(rows) + firm[p] - sum(f for _, f in rows) + 1)
        belief = {}
        for (p, m, k), (_, is_base) in edges.items():
            if not is_base and (p, k) in trust:
                belief[k, m] = max(belief.get((k, m), 0.0), trust[p, k])
    best = {}
    for (k, m), b in belief.items():
        if b >= pii.CONFIDENCE:
            best[m] = max(best.get(m, (0.0, "")), (b, k))
    out = []
    for own, found in zip(base, free, strict=True):
        spans = list(own) + [(best[w.lower()][1], s, e) for s, e, w, _ in found if w.lower() in best]
        out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), *x[1:])))
    return out


def planted(seed=3):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    hexa = lambda n, alphabet="0123456789abcdef": "".join(rng.choices(alphabet, k=n))
    texts = [f"{say(4)} api token = \"{hexa(40)}\" {say(3)}" for _ in range(12)]
    texts += [f'{say(3)} API TOKEN = "{hexa(40, "0123456789ABCDEF")}" {say(2)}', f'{say(3)} api token = "K9x-{hexa(20)}_Zz" {say(2)}']  # unlike the seeds
    texts += [f"{say(2)} see commit {hexa(40)} {say(2)}" for _ in range(4)]  # no keys
    texts += [f"{say(3)} phone me on +1 (988) 555-{1000 + i} {say(2)}" for i in range(7)] + [f"{say(3)} phone me on 988-555-7777 {say(2)}"]
    texts += [f"{say(2)} the server at 10.0.{i}.7 {say(2)}" for i in range(6)] + [f"{say(1)} the server at 10.0.300.7 {say(2)}"]
    texts += [f"{say(2)} write to u{i}@mail.example.org {say(2)}" for i in range(6)] + [f"{say(2)} write to root@localhost {say(2)}", f"{say(2)} root@localhost {say(2)}"]
    texts += [f"{say(3)} version 2.0.1 of {rng.randrange(10**7)} {say(2)}" for _ in range(6)]
    return [*texts, texts[0], "", "12"]


@pytest.fixture(scope="module")
def found(spark):
    rows = planted()
    return rows, {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}


def test_against_a_plain_version(found):
    texts, got = found
    for i, spans in enumerate(brute(texts)):
        assert got[i]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans), texts[i]
        assert got[i]["base"] == ",".join(base_spans(texts[i])) and got[i]["n_discovered"] == len(spans) - len(base_spans(texts[i]))


def test_planted_identifiers(found):
    texts, got = found
    said = {i: [(x.split(":")[0], texts[i][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got[i]["spans"].split(",") if x] for i in got}
    secrets = [v for r in said.values() for k, v in r if k == "secret"]
    assert len(secrets) == 15 and any(v.startswith("K9x-") for v in secrets) and any(v.isupper() for v in secrets)
    assert ("phone", "988-555-7777") in [x for r in said.values() for x in r]
    assert ("ip", "10.0.300.7") in [x for r in said.values() for x in r]
    assert [r for r in said.values()].count([("email", "root@localhost")]) == 2  # the second stands in no known context
    assert not any(said[i] for i, t in enumerate(texts) if "commit" in t or "version" in t)


def test_mask_keeps_columns_of_any_name(spark):
    secret = "0123456789abcdef" * 2
    rows = [(i, f'the key = "{secret[:-1]}{i}" x', None, [1], 2, {"a": i}, 4, None) for i in range(5)] + [(None, None, "r", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, parts array<int>, every int, own map<string,int>, n_chars int, `a b` string")
    out = pii.mask(df)
    assert out.columns == df.columns and out.count() == 6
    r = out.where("doc_id = 3").first()
    assert r["text"] == 'the key = "<SECRET>" x' and r["own"] == {"a": 3} and r["parts"] == [1] and r["n_chars"] == len(r["text"])
    assert out.where("doc_id is null").first()["rid"] == "r"
