"""Page differencing against a plain version of the whole operator."""

import random
import time

from prosegauge.llm import html_main
from prosegauge.llm.html_main import FURNITURE, MAIN, PLAIN


def common_subsequence(a, b):
    """Which of ``a`` lie in one longest common subsequence, by the quadratic table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table[0][0]


def brute(pages):
    """Text of each page, where every shared line has one place in either page, so that the alignment is unique."""
    parsed = [(html_main.address(u), *html_main.page_lines(h or "")) for _, u, h in pages]
    distinct = sorted({(a, tuple(lines), tuple(kinds)) for a, lines, kinds in parsed})
    out = []
    for a, lines, kinds in parsed:
        own = MAIN if MAIN in kinds else PLAIN
        at = distinct.index((a, tuple(lines), tuple(kinds)))
        best = None
        for j in (at - 1, at + 1):
            if 0 <= j < len(distinct) and distinct[j][0][0] == a[0]:
                other = distinct[j][1]
                shared = [x in other for x in lines]
                assert sum(shared) == common_subsequence(lines, list(other))
                total = sum(len(x) for x, k in zip(lines, kinds, strict=True) if k == own)
                both = sum(len(x) for x, k, s in zip(lines, kinds, shared, strict=True) if k == own and s)
                prefix = next((i for i, (x, y) in enumerate(zip(a[1], distinct[j][0][1], strict=False)) if x != y), min(len(a[1]), len(distinct[j][0][1])))
                found = (total > 0 and both >= html_main.COPY * total, -prefix, j, shared)
                best = min(best, found, key=lambda x: x[:3]) if best else found
        gone = [s and k != MAIN and not best[0] for s, k in zip(best[3], kinds, strict=True)] if best else [False] * len(lines)
        out.append((" ".join(x for x, k, g in zip(lines, kinds, gone, strict=True) if k == own and not g), sum(gone)))
    return out


def site(seed=2):
    rng = random.Random(seed)
    say = lambda i, k: " ".join(f"{rng.choice('abcdefgh')}{i}x{k}{n}" for n in range(rng.randrange(4, 12)))
    rows = []
    for i in range(60):
        host = rng.choice(["a.example", "b.example", "c.example"])
        body = "".join(f"<p>{say(i, k)}</p>" for k in range(rng.randrange(2, 6)))
        template = f"<div>Welcome to {host}</div>%s<div>Imprint of {host}</div><div>All rights</div>"
        if i % 3 == 0:
            body = f"<nav>Menu {i} of {host}</nav><div class=ad>Buy {i}</div><article>{body}<p>Common licence line</p></article><footer>Foot</footer>"
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{i}", template % body))
    rows.append((100, rows[0][1] + "copy", rows[0][2]))  # a copy under a neighbouring address
    rows.append((101, rows[1][1], rows[1][2]))
    return [*rows, (102, None, None), (103, "http://lone.example/", rows[1][2]), (104, "http://[bad", "<p>x</p>"), (105, "", "")]


def test_against_a_plain_version(spark):
    rows = site()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, k string, lines int")
    fates = {r["page_id"]: r for r in html_main.line_fates(df).collect()}
    got = {r["page_id"]: (r["text"], fates[r["page_id"]]["n_differenced"]) for r in html_main.main_text(df).collect()}
    want = {r[0]: x for r, x in zip(rows, brute(rows), strict=True)}
    assert got == want
    unmarked = [i for i in range(60) if i % 3]
    assert sum(got[i][1] for i in unmarked) >= 2 * len(unmarked)  # differencing decides
    assert sum(r["n_protected"] for r in fates.values()) >= 5
    assert all("Common licence line" in got[i][0] for i in range(0, 60, 3))


def test_small_blocks_change_nothing(spark):
    df = spark.createDataFrame(site(), "page_id long, url string, html string")
    parsed = html_main.parse(df)
    assert sorted(map(tuple, html_main.differences(parsed, 3).collect())) == sorted(map(tuple, html_main.differences(parsed).collect()))


def test_parsing_is_linear():
    for page in ("<a " * 30_000, "<div>" * 30_000 + "</b>" * 30_000 + "</div>" * 30_000, '<a "' * 30_000 + ">", "<!-- " * 30_000, "<script>" * 30_000, "</script " * 30_000 + ">", "<a '>" * 30_000, "&#x" * 30_000):
        began = time.perf_counter()
        html_main.page_lines(page)
        assert time.perf_counter() - began < 3


def test_odd_markup():
    lines = lambda page: html_main.page_lines(page)
    assert lines('<p>a <b title="x>y">b</b> "c</p>tail <x') == (['a b "c', "tail <x"], [PLAIN, PLAIN])
    assert lines("a<!-- never ends <p>b</p>") == (["a"], [PLAIN])
    assert lines("<article>m<aside>s</aside><p>n</article>o") == (["m", "s", "n", "o"], [MAIN, FURNITURE, MAIN, PLAIN])
    assert lines("1 < 2 > 0") == (["1 < 2 > 0"], [PLAIN])
