"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one for each block with text, in page order; each line
knows whether it stands in page furniture (menus, headers, footers, sidebars,
adverts, notices, forms, comments: by element, role, class and id), in the
marked main text (``main`` or ``article``), or in neither. Scripts, styles, the
head and markup never become lines.

Pages are sorted by host and URL path, and each is paired with the neighbour in
its host that shares the longer beginning of the path. The lines of the two are
aligned by a longest common subsequence; shared lines are the site's, not the
page's, and go. Marks add to that what differencing cannot know: lines in
furniture go though no neighbour has them, and lines in marked main text stay
though a neighbour has them, as articles quote the same passages. Of pages with
marked main text the rest goes too. A neighbour with which a page shares nearly
all of its text is a copy and proves nothing: the other neighbour is taken, and
where that is a copy as well unmarked lines stay.

Every page is aligned. A range shuffle sorts line hashes, not texts; neighbours
are looked up over the global order in blocks, so a host of any size spreads over
many tasks. Pages are parsed twice, for their hashes and for their texts, so that
only the lines of pages without marked main text move, to meet their alignment. Work
on a page is linear in its length but for the alignment.

Cases: null and empty html give an empty text; a null or odd URL has an empty
host and path; pages equal in URL and lines count as one page when neighbours
are sought; a host's only page keeps all its lines but marked furniture; repeated
rows give a row each; tags that never end and quotes that never close are text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import durable, mapped, shuffle_partitions

FURNITURE, PLAIN, MAIN = 0, 1, 2
#: Pages whose neighbours are looked up together.
BLOCK = 64
#: Share of a page's text in aligned lines from which its neighbour counts as a copy.
COPY = 0.8

# Elements, roles and words of class or id.
BLOCKS = set("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style template noscript iframe object svg math textarea title noembed noframes xmp canvas audio video".split())
FURNITURE_TAGS = set("nav footer aside form button select menu dialog head search".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
FURNITURE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header hidden masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN_WORDS = set("article post entry story content main body text".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# A p may stay open; one of these then ends it.
_P_ENDS = BLOCKS - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "option", "optgroup", "legend", "figcaption", "summary"}

# searched up to the last ">" of a page, within which every tag that begins also ends: a quote that never closes is a character like any other
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


def _kind(name: str, attributes: str, above: int) -> int:
    """What an element's text is, given what it stands in."""
    if above == FURNITURE or name in FURNITURE_TAGS or (name == "header" and above != MAIN):
        return FURNITURE
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return FURNITURE
            if key == "role" and value in FURNITURE_ROLES:
                return FURNITURE
            if key == "role" and value == "main":
                return MAIN
            if key in ("class", "id") and name not in ("body", "html", "article", "main"):
                words = set(_WORD.findall(value))
                if words & FURNITURE_WORDS and not (words & MAIN_WORDS and words & FURNITURE_WORDS <= {"header"}):
                    return FURNITURE
    return MAIN if name in ("article", "main") else above


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page and what each is."""
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}  # how many elements of a name the stack holds
    kind = PLAIN

    def end_line() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append(text)
                kinds.append(kind)

    def pop() -> int:
        """Leave the innermost element: what the text is then."""
        open_[stack.pop()[0]] -= 1
        return stack[-1][1] if stack else PLAIN

    def push(name: str, new: int) -> None:
        stack.append((name, new))
        open_[name] = open_.get(name, 0) + 1

    def leave(name: str, block: bool) -> None:
        """Close the innermost element of a name that is open, and all within it."""
        nonlocal kind
        while stack[-1][0] != name:
            pop()
        below = pop()
        if block or below != kind:
            end_line()
        kind = below

    at, n, last = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        name = m[2].lower()
        block = name in BLOCKS or name in FURNITURE_TAGS
        if name == "br":
            held.append(" ")
        elif not m[1] and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at, last)
            at = end.end() if end else n
        elif m[1]:
            if open_.get(name):
                leave(name, block)
            elif block:
                end_line()
        elif block or (m[3] and name not in VOID):
            new = _kind(name, m[3], kind)
            if not block and new == kind:
                if not m[3].endswith("/"):
                    push(name, new)
                continue
            end_line()
            if name == "hr":
                continue
            while stack and stack[-1][0] == "p" and name in _P_ENDS:
                kind = pop()
                new = _kind(name, m[3], kind)
            push(name, new)
            kind = new
    end_line()
    return lines, kinds


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty where it has none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", ""


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of ``a`` lie in a longest common subsequence of both, by bit-parallel dynamic programming."""
    shared = [False] * len(a)
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        shared[start] = True
        start += 1
    enda, endb = len(a), len(b)
    while enda > start and endb > start and a[enda - 1] == b[endb - 1]:
        enda, endb = enda - 1, endb - 1
        shared[enda] = True
    x, y = a[start:enda], b[start:endb]
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for v in x:
        s = rows[-1]
        u = s & where.get(v, 0)
        rows.append((s + u | s - u) & full)
    # bit j of row i is 0 where the subsequence of x[:i] and y[:j + 1] is longer than that of x[:i] and y[:j]
    j = len(y)
    for i in range(len(x), 0, -1):
        low = (1 << j) - 1
        if (rows[i] & low).bit_count() == (rows[i - 1] & low).bit_count():
            continue
        grown = ~rows[i] & rows[i - 1] & low  # one more match than without x[i - 1]
        while j and (where.get(x[i - 1], 0) >> (j - 1) & 1) == 0:
            j -= 1
            low = (1 << j) - 1
            if (rows[i] & low).bit_count() == (rows[i - 1] & low).bit_count():
                grown = 0
                break
        if j and grown:
            shared[start + i - 1] = True
            j -= 1
    return shared


def _hash(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64)


_PARSED = "page_id long, host string, path string, k binary, kinds binary, lengths binary, hashes binary"


def _key(host: str, path: str, kinds: list[int], hashes: np.ndarray) -> bytes:
    """128 bits that equal pages of one address share."""
    import xxhash

    return xxhash.xxh3_128_digest(f"{host}\0{path}\0".encode("utf-8", "surrogatepass") + bytes(kinds) + b"\0" + hashes.tobytes())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's address and key, and its lines by kind, length and hash."""
    names = [c.split()[0] for c in _PARSED.split(", ")]
    types = [pa.string(), pa.string(), *[pa.binary()] * 4]
    for b in batches:
        rows = []
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            lines, kinds = page_lines(page or "")
            host, path = address(url)
            hashes = _hash(lines)
            rows.append((host, path, _key(host, path, kinds, hashes), bytes(kinds), np.array(list(map(len, lines)), np.int32).tobytes(), hashes.tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with marked main text: their text. The others: their key, and their lines outside furniture with nulls in its place."""
    for b in batches:
        marked, keys, plain = [], [], []
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            lines, kinds = page_lines(page or "")
            if MAIN in kinds:
                marked.append(" ".join(x for x, k in zip(lines, kinds, strict=True) if k == MAIN))
                keys.append(None)
                plain.append(None)
            else:
                marked.append(None)
                keys.append(_key(*address(url), kinds, _hash(lines)))
                plain.append([x if k == PLAIN else None for x, k in zip(lines, kinds, strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(marked, pa.string()), pa.array(keys, pa.binary()), pa.array(plain, pa.list_(pa.string()))], ["page_id", "url", "text", "k", "lines"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, row = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(row, row + n))], [*b.schema.names, "task", "row"])
        row += n


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def is_copy(kinds: list[int], lengths: list[int], shared: list[bool]) -> bool:
    """Whether nearly all of a page's text, the marked main text if there is any, lies in shared lines."""
    own = MAIN if MAIN in kinds else PLAIN
    total = sum(n for n, k in zip(lengths, kinds, strict=True) if k == own)
    both = sum(n for n, k, s in zip(lengths, kinds, shared, strict=True) if k == own and s)
    return total > 0 and both >= COPY * total


def _differ(group: pd.DataFrame) -> pd.DataFrame:
    """The shared lines of the block's own pages that have a neighbour in their host."""
    group = group.sort_values("rank", ignore_index=True)
    rows = list(group.itertuples(index=False))
    hashes = [np.frombuffer(r.hashes, np.int64).tolist() for r in rows]
    out = []
    for i, r in enumerate(rows):
        if not r.own:
            continue
        kinds, lengths = list(r.kinds), np.frombuffer(r.lengths, np.int32).tolist()
        found = []
        for j in (i - 1, i + 1):
            if 0 <= j < len(rows) and abs(rows[j].rank - r.rank) == 1 and rows[j].host == r.host:
                shared = shared_lines(hashes[i], hashes[j])
                found.append((is_copy(kinds, lengths, shared), -_common(rows[j].path, r.path), rows[j].rank, shared))
        if found:
            copy, _, _, shared = min(found, key=lambda x: x[:3])
            out.append((r.k, bytes(shared), copy))
    return pd.DataFrame(out, columns=["k", "shared", "copy"]).astype({"copy": bool})


def _own(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def parse(pages: DataFrame) -> DataFrame:
    """What the alignment reads of every row of ``pages(page_id, url, html)``, written: address, key, and the lines' kinds, lengths and hashes."""
    return durable(mapped(_own(pages), _parsed, _PARSED), "parsed")


def differences(parsed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``k, shared, copy`` of each page with a neighbour, by its key: a byte for each line that is 1 if the nearest page has it too, and whether that page is a copy."""
    spark = parsed.sparkSession
    columns = ("host", "path", "kinds", "lengths", "hashes")
    one = parsed.groupBy("k").agg(*[F.first(c).alias(c) for c in columns]).select("k", *columns)
    ranged = one.repartitionByRange(shuffle_partitions(spark), "host", "path", "k").sortWithinPartitions("host", "path", "k")
    schema = "k binary, host string, path string, kinds binary, lengths binary, hashes binary, task int, row long"
    numbered = durable(mapped(ranged, _numbered, schema), "numbered")
    before, offsets = 0, []
    for task, n in sorted((r["task"], r["n"]) for r in numbered.groupBy("task").agg(F.count("*").alias("n")).collect()):  # a row for each task
        offsets.append((task, before))
        before += n
    base = F.broadcast(spark.createDataFrame(offsets, "task int, base long"))
    ranked = numbered.join(base, "task").withColumn("rank", F.col("row") + F.col("base")).drop("task", "row", "base")
    # a page at the edge of a block also goes to the next block, as a neighbour
    own = (F.col("rank") / block).cast("long")
    places = F.array_distinct(F.array(own, ((F.col("rank") - 1) / block).cast("long"), ((F.col("rank") + 1) / block).cast("long")))
    spread = ranked.select("*", own.alias("home"), F.explode(places).alias("block")).withColumn("own", F.col("home") == F.col("block")).drop("home")
    return spread.groupBy("block").applyInPandas(_differ, "k binary, shared binary, copy boolean")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What differencing leaves of pages without marked main text."""
    for b in batches:
        out = []
        for lines, shared, copy in zip(*(b.column(c).to_pylist() for c in ("lines", "shared", "copy")), strict=True):
            gone = shared if shared is not None and not copy else bytes(len(lines))
            out.append(" ".join(x for x, g in zip(lines, gone, strict=True) if x is not None and not g))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages(page_id, url, html)``."""
    shared = durable(differences(parse(pages)), "shared")
    own = mapped(_own(pages), _texts, "page_id long, url string, text string, k binary, lines array<string>")
    moved = own.where("text is null").select("page_id", "url", "k", "lines").join(shared, "k", "left").select("page_id", "url", "lines", "shared", "copy")
    return own.where("text is not null").select("page_id", "url", "text").unionByName(mapped(moved, _left, "page_id long, url string, text string"))


def _fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = []
        for kinds, shared, copy in zip(*(b.column(c).to_pylist() for c in ("kinds", "shared", "copy")), strict=True):
            own = MAIN if MAIN in kinds else PLAIN
            gone = [bool(s) and k != MAIN for s, k in zip(shared, kinds, strict=True)] if shared is not None and not copy else [False] * len(kinds)
            counts.append((len(kinds), sum(gone), sum(k != own and not g for k, g in zip(kinds, gone, strict=True)), sum(bool(s) and k == MAIN for s, k in zip(shared or bytes(len(kinds)), kinds, strict=True))))
        columns = list(zip(*counts, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.int64()) for c in columns)], ["page_id", "n_lines", "n_differenced", "n_marked", "n_protected"])


def line_fates(pages: DataFrame) -> DataFrame:
    """For each page: its lines, those that go by differencing, those that go by marks alone, and shared ones that marks protect."""
    parsed = parse(pages)
    both = parsed.select("page_id", "k", "kinds").join(durable(differences(parsed), "shared"), "k", "left").select("page_id", "kinds", "shared", "copy")
    return mapped(both, _fates, "page_id long, n_lines long, n_differenced long, n_marked long, n_protected long")
