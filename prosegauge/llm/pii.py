r"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the matches of four base patterns (emails, IP addresses, card numbers
that pass Luhn, phone numbers) and, for a fifth kind, ``secret``, tokens that look
like keys: 32, 40 or 64 hexadecimal digits in lower case that no word such as
*commit* or *md5* introduces. Secret seeds are only evidence: they become spans if
their context is trusted, as other tokens do.

Contexts of a match or token become lexical patterns, at several levels, so that
rare long ones back off to shorter ones: the three, two and one pieces before it,
and the piece before with the piece after. Pieces stand between white space, in
lower case with digits as 0; marks that touch a token, as in ``key="...``, are
pieces too. A pattern joins a context with the shape of what stands in it (kinds of
characters and a length class), so that it speaks of tokens alike.

Patterns and what stands in them form a graph, over distinct pairs so that copied
passages count once. Each round scores both sides: a pattern by the share of
its distinct instances that are believed, with one added to the count, so that
rare patterns stay doubtful; a token by its best pattern. Base matches are believed,
of their own kind alone. A pattern takes part once ``LEAST_SEEDS`` of its
instances are seeds or tokens believed to ``CONFIDENCE``, so tokens found in one
round induce patterns in the next. Tokens believed in the end become spans
wherever they stand; base spans stay.

Positions come without Python: the text between matches (split) and the matches
alternate, so running sums of their lengths, in a window over one document's
short rows, are the positions, and pieces of context are read from the neighbouring
parts, reversed so that the regex engine looks no further than it must. Repeated
groups are possessive, which changes no match of these patterns and keeps the
engine from recursing or going back on long runs.

Cases: null and empty texts have no spans; repeated rows are handled one by one
(each has a row number of its own); an empty table gives no rows; very common
contexts, tokens or documents are counted with partial sums, and joins are on
plain tables that adaptive execution can split; other columns, whatever their
names, pass through ``mask`` and are ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import durable

KINDS = ["email", "ip", "card", "phone"]
FOUND = [*KINDS, "secret"]
ROUNDS = 3
CONFIDENCE = 0.75
LEAST_SEEDS = 3

_LOCAL = r"[A-Za-z0-9._%+-]"
# a run that failed at its start fails anywhere inside; \G: a match may begin where the last one ended
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: with a digit or an at sign, without the marks around them.
_BREAK = r"\s\"'(),;:!?<>\[\]{}|="
TOKEN = rf"(?<![^{_BREAK}])(?=[^{_BREAK}0-9@]*+[0-9@])[^{_BREAK}]++"
_NEEDS = {"email": "@", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Keys by their looks, and what introduces hexadecimal numbers that are none.
KEY = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
NO_KEY = r"\b(?:commit|revision|rev|sha|sha0+|md0|checksum|digest|etag|hash|blob|tree|fingerprint|uuid|guid)\W*$"
#: Contexts longer than this are known by their MD5.
_LONG = 96


def _parts(text: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern in order, each with the length of the text before it and its contexts."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(between.alias("b"), found.alias("m"))  # one more text between than matches: the last match is null
    placed = F.transform(zipped, lambda x, i: F.struct(i.alias("i"), x["b"].alias("b"), F.coalesce(x["m"], F.lit("")).alias("m"), x["m"].isNotNull().alias("found")))

    def of_match(all_: Column) -> Column:
        at = lambda j: F.get(all_, j)
        part = lambda j, name: F.coalesce(at(j)[name], F.lit(""))

        def one(x: Column) -> Column:
            i = x["i"]
            before = F.concat(*[F.concat(part(i - k, "b"), part(i - k, "m")) for k in (3, 2, 1)], x["b"])
            after = F.concat(part(i + 1, "b"), part(i + 1, "m"), part(i + 2, "b"))
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["b"]).alias("gap"), x["m"].alias("m"), _pieces(F.reverse(before), 3).alias("left"), _pieces(after, 1).alias("right"))

        return F.transform(F.filter(all_, lambda x: x["found"]), one)

    # evaluated once, however often a context looks at its neighbours
    return F.get(F.transform(F.array(placed), of_match), F.lit(0))


def _pieces(text: Column, n: int) -> Column:
    """The first pieces of a text, at most ``n``; marks that touch the start are a piece."""
    return F.regexp_extract(text, r"^(?:\s*+[^\s\w]++(?=\w)|\s*+\S++){0," + str(n) + "}", 0)


def contexts(left: Column, right: Column) -> Column:
    """The patterns' contexts, by level, of the reversed pieces before and the pieces after."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    short = lambda c: F.when(F.length(c) > _LONG, F.md5(c)).otherwise(c)
    spaced = lambda c: F.regexp_replace(c, r"\s++", " ")

    def before(n: int) -> Column:
        return spaced(plain(F.reverse(_pieces(left, n))))

    level = lambda name, c: F.concat(F.lit(f"{name}:"), short(c))
    three, two, one = before(3), before(2), before(1)
    both = F.concat(one, F.lit("_"), spaced(plain(right)))
    every = F.array(F.when(three != two, level("3", three)), F.when(two != one, level("2", two)), F.when(one != "", level("1", one)), F.when(one != "", level("b", both)))
    return F.filter(every, lambda c: c.isNotNull())


def shape(m: Column) -> Column:
    """What a token is made of, and whether it is long enough for its kind to say something."""
    n = F.length(m)
    kind = F.when(m.contains("@"), "@").when(m.rlike(r"^[0-9]+$"), "0").when(m.rlike(r"^[+0-9][0-9() .\-]*$") & ~m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "0-").when(m.rlike(r"^[0-9.]+$"), "0.").otherwise("w")
    return F.concat(kind, F.when(n >= F.when(kind == "w", 16).otherwise(6), "+").otherwise(""))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid() -> Column:
    kind, m = F.col("kind"), F.col("m")
    n = F.length(_digits(m))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & luhn(F.substring(_digits(m), 1, 20)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


_PART = "struct<kind:string,i:int,gap:int,m:string,left:string,right:string>"


def _rows(docs: DataFrame, keep: list[str], label: str) -> DataFrame:
    """A written row for each document: ``rid``, the columns of ``keep`` as ``own``, and ``parts``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(f"array<{_PART}>")
    digit = text.rlike("[0-9]")
    parts = [F.when(text.contains(_NEEDS[k]) if k in _NEEDS else digit, _parts(text, k, p)).otherwise(none) for k, p in PATTERNS.items()]
    parts.append(F.when(digit | text.contains("@"), _parts(text, "", TOKEN)).otherwise(none))
    return durable(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), F.concat(*parts).alias("parts")), label)


def _located(rows: DataFrame) -> DataFrame:
    """Every valid base match and every candidate token with its positions: ``rid, kind, s, e, m, left, right``."""
    flat = rows.where(F.size("parts") > 0).select("rid", F.inline("parts"))
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("gap").cast("long") + F.length("m")).over(before)
    at = flat.select("rid", "kind", "m", "left", "right", (ends - F.length("m")).alias("s"), ends.alias("e")).where(_valid())
    m = F.when(F.col("kind") == "", F.regexp_replace("m", r"[.\-+*#$%&]++$", "")).otherwise(F.col("m"))  # without marks at a token's end
    return at.select("rid", "kind", "s", (F.col("s") + F.length(m)).alias("e"), m.alias("m"), "left", "right").where("e > s")


def _free(at: DataFrame) -> DataFrame:
    """Without the candidate tokens that overlap a base span."""
    base = F.col("kind") != ""
    earlier = Window.partitionBy("rid").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("rid").orderBy("s").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    marked = at.withColumn("ended", F.max(F.when(base, F.col("e"))).over(earlier)).withColumn("begun", F.min(F.when(base, F.col("s"))).over(later))
    clear = ~base & (F.coalesce("ended", F.lit(0)) <= F.col("s")) & (F.col("begun").isNull() | (F.col("begun") >= F.col("e")))
    return marked.where(base | clear).drop("ended", "begun")


def looks_like(kind: Column, m: Column) -> Column:
    """Whether a token may be an identifier of a kind, by its characters."""
    n = F.length(_digits(m))
    letters = m.rlike("[A-Za-z]") & (n >= 1)
    return (
        F.when(kind == "email", m.contains("@"))
        .when(kind == "ip", (n >= 3) & m.rlike(r"^[0-9A-Fa-f.:]*[.:][0-9A-Fa-f]*[.:][0-9A-Fa-f.:]*$"))
        .when(kind == "card", (n >= 12) & m.rlike(r"^[0-9 \-]+$"))
        .when(kind == "phone", n.between(6, 15) & m.rlike(r"^[+0-9 ().\-/]+$"))
        .otherwise((F.length(m) >= 16) & letters & m.rlike(r"^[A-Za-z0-9+/_\-.~]+$"))
    )


def edges_of(at: DataFrame) -> DataFrame:
    """The graph's distinct pairs of pattern and instance: ``p, kind, m, k, seed``, of base matches and of tokens for each kind that they look like."""
    lower = F.lower("m")
    key = (F.col("kind") == "") & F.col("m").rlike(KEY) & ~F.regexp_replace(F.lower(F.reverse("left")), "[0-9]", "0").rlike(NO_KEY)
    kinds = F.filter(F.array(*map(F.lit, FOUND)), lambda k: looks_like(k, F.col("m")))
    may = F.when(F.col("kind") != "", F.array("kind")).otherwise(kinds)
    seed = F.when(F.col("kind") != "", F.col("kind")).when(key, "secret").otherwise("")
    rows = at.select(contexts(F.col("left"), F.col("right")).alias("contexts"), shape(lower).alias("shape"), lower.alias("m"), may.alias("may"), seed.alias("seed"), "kind").where(F.size("may") > 0)
    flat = rows.select(F.explode("contexts").alias("c"), "shape", "m", "may", "seed", "kind").select(F.concat("c", F.lit("|"), "shape").alias("p"), "m", F.explode("may").alias("k"), "seed", (F.col("kind") != "").alias("base"))
    # a token that is a seed somewhere is one wherever it stands
    return flat.groupBy("p", "m", "k").agg(F.max(F.col("seed") == F.col("k")).alias("seed"), F.max("base").alias("base"))


def _discovered(at: DataFrame) -> DataFrame:
    """``found, m`` of the tokens that patterns of high confidence vouch for."""
    edges = durable(edges_of(at), "edges")
    believed = None
    for _ in range(ROUNDS):
        rows = edges
        if believed is not None:
            rows = edges.join(believed, ["k", "m"], "left")
        # below confidence nothing counts, or a pattern would vouch for itself by way of its tokens
        belief = F.when(F.col("b") >= CONFIDENCE, F.col("b")).otherwise(0.0) if believed is not None else F.lit(0.0)
        worth = F.when(F.col("seed"), 1.0).when(F.col("base"), 0.0).otherwise(belief)
        # what a pattern holds of other kinds counts against it: an instance counts once, for its own kind
        scored = rows.select("p", "k", "m", "base", worth.alias("w"))
        own = scored.groupBy("p", "k").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.sum((F.col("w") >= CONFIDENCE).cast("int")).alias("sure"), F.sum(F.col("base").cast("int")).alias("firm"))
        own = durable(own, "patterns")
        firm = own.groupBy("p").agg(F.sum("firm").alias("all_firm"))
        trust = own.where(f"sure >= {LEAST_SEEDS}").join(firm, "p").select("p", "k", (F.col("w") / (F.col("n") + F.col("all_firm") - F.col("firm") + 1)).alias("trust"))
        trust = durable(trust, "trust")
        believed = durable(edges.where("not base").join(trust, ["p", "k"]).groupBy("k", "m").agg(F.max("trust").alias("b")), "believed")
    # a token goes to the kind that vouches for it most
    best = believed.where(f"b >= {CONFIDENCE}").groupBy("m").agg(F.max(F.struct("b", "k")).alias("best"))
    return best.select("m", F.col("best.k").alias("found"))


def _spans(rows: DataFrame) -> DataFrame:
    """``rid, every``: the base spans and all others of each document that has any, by kind and start."""
    at = durable(_free(_located(rows)), "located")
    found = durable(_discovered(at), "found")
    extra = at.where("kind = ''").withColumn("m", F.lower("m")).join(found, "m").select("rid", F.col("found").alias("kind"), "s", "e", F.lit(False).alias("base"))
    every = at.where("kind <> ''").select("rid", "kind", "s", "e", F.lit(True).alias("base")).unionByName(extra)
    order = F.array_position(F.array(*map(F.lit, FOUND)), F.col("kind"))
    one = F.struct(order.alias("o"), "s", "e", "kind", "base")
    return every.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("every"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: the counts of base spans by kind, ``base`` and ``spans`` as text, and the number of spans found by context."""
    rows = _rows(docs, ["doc_id"], "parts")
    every = F.coalesce("every", F.array().cast("array<struct<o:bigint,s:bigint,e:bigint,kind:string,base:boolean>>"))
    out = rows.select("rid", F.col("own.doc_id").alias("doc_id")).join(_spans(rows), "rid", "left").select("doc_id", every.alias("every"))
    out = out.withColumn("own", F.filter("every", lambda x: x["base"]))
    counts = [F.expr(f"cast(size(filter(own, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, _joined(F.col("own")).alias("base"), _joined(F.col("every")).alias("spans"), (F.size("every") - F.size("own")).cast("long").alias("n_discovered"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and n_chars renewed if there is one.

    Spans may overlap across kinds; those that do are replaced together, by the kind of the first, of equal starts the longest.
    """
    rows = _rows(docs, docs.columns, "parts")
    spans = _spans(rows).select("rid", F.array_sort(F.transform("every", lambda x: F.struct(x["s"], (-x["e"]).alias("to"), x["e"], x["kind"]))).alias("every"))
    out = rows.select("rid", "own", F.col("own.text").cast("string").alias("raw")).join(spans, "rid", "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substr(F.col("raw"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    masked = F.aggregate("every", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("raw"), (acc["at"] + 1).cast("int"))))
    out = out.select("own", F.col("every").isNotNull().alias("any"), F.when(F.col("every").isNotNull(), masked).otherwise(F.col("raw")).alias("masked"))
    renewed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.when(F.col("any"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own.n_chars"))
    return out.select(*[(renewed[c] if c in renewed else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
