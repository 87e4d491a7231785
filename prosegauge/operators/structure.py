"""Sentence and paragraph structure.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg

LOW_STD, MODERATE_STD = 4.0, 6.0
TOLERANCE, LEAST_RUN = 3, 3

# What each pattern accepts.
PARTICIPIAL = r"(?Umd),\s+\w+ing\s+[\w\s]+[.!?]$"
NEGATIVE_PARALLELISM = r"(?id)(?:it'?s not .{3,40}(?:,|—|-{1,2})\s*it'?s|it'?s less about .{3,40} and more about|not just .{3,40},?\s*but also|more than just .{3,40}\.\s*it'?s)"
SELF_ANSWER = r"(?Umd)(?:^|\. )(?:The|What|Why|How) [^.?]{3,40}\?\s+[A-Z][^.?]{2,40}\."
# the first part ends before a comma, which it cannot hold: possessive, it matches the same without going back. The leftmost
# match begins where the last one ended, after a comma, or 60 characters before one, so the engine tries no other place
TRICOLON = r"(?U)(?:\G|(?<=,)|(?=[^,]{60},))[^,]{2,60}+,\s+[^,]{2,60},?\s+(?i:and)\s+[^,]{2,60}"
BOTH_SIDES = r"(?Uis)on\s+(?:the\s+)?one\s+hand\b.*?\bon\s+the\s+other\s+hand\b"
ANALOGY = r"(?Uid)just\s+as\s+.{10,80}just\s+as\s+"
DISCLAIMER = r"(?Ui)(?:this\s+is\s+not\s+(?:an?\s+)?exhaustive|not\s+(?:an?\s+)?exhaustive\s+(?:list|treatment|analysis|overview)|beyond\s+the\s+scope\s+of\s+this|space\s+does\s+not\s+permit|there\s+are[,\s]+of\s+course[,\s]+(?:important\s+)?(?:caveats|limitations)|this\s+analysis\s+has\s+(?:certain\s+)?limitations)"


def runs(values: Column, same) -> Column:
    """Maximal runs of neighbours for which ``same(a, b)`` holds: structs of first place (from 1) and length."""
    kind = "array<struct<first:int,n:int>>"
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))
    placed = F.transform(values, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"), F.when(i > 0, F.get(values, i - 1)).alias("before")))

    def step(acc: Column, x: Column) -> Column:
        goes_on = F.coalesce(same(x["before"], x["v"]), F.lit(False))
        closed = F.when(acc["n"] > 0, F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"))))).otherwise(acc["out"])
        return F.when(goes_on, F.struct(acc["first"].alias("first"), (acc["n"] + 1).alias("n"), acc["out"].alias("out"))).otherwise(F.struct(x["i"].alias("first"), F.lit(1).alias("n"), closed.alias("out")))

    return F.aggregate(placed, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"))))).otherwise(acc["out"]))


def streaks() -> Column:
    """Runs of at least three sentences whose lengths differ by three words at most from one to the next."""
    return F.filter(runs(F.col("sent_words"), lambda a, b: F.abs(a - b) <= TOLERANCE), lambda r: r["n"] >= LEAST_RUN)


def anaphora() -> Column:
    """Runs of at least three sentences that begin with the same word, common ones left out."""
    begins = F.col("first_words")
    return F.filter(runs(begins, lambda a, b: a == b), lambda r: (r["n"] >= LEAST_RUN) & ~F.get(begins, r["first"] - 1).isin(lex.ANAPHORA_SKIPPED))


def length_std() -> Column:
    return seg.sample_std(F.col("sent_words"))


def paragraph_sentences() -> Column:
    """The sentences of each paragraph: a column of its own, ``para_sents``, as splitting is dear. A text that is one paragraph has been split already."""
    whole = (F.size("paras") == 1) & (F.get("paras", F.lit(0)) == F.col("t"))
    return F.when(whole, F.array("sents")).otherwise(F.transform("paras", seg.sentences))


def fractal() -> Column:
    """Paragraphs (from 1) of three sentences or more whose first and last overlap by more than half."""
    def of(s: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("i"), F.when(F.size(s) >= 3, seg.overlap(F.get(s, F.lit(0)), F.element_at(s, -1))).alias("x"))

    return F.filter(F.transform("para_sents", of), lambda r: F.coalesce(r["x"], F.lit(0.0)) > 0.5)


def conclusion_overlap() -> Column:
    return F.when(F.size("paras") >= 4, seg.overlap(F.try_element_at("paras", F.lit(1)), F.try_element_at("paras", F.lit(-1))))


def essay_formula() -> Column:
    holds = lambda at, terms: F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(F.lower(F.try_element_at("paras", F.lit(at))), x))
    return F.coalesce((F.size("paras") >= 4) & holds(1, lex.ESSAY_INTRODUCTION) & holds(-1, lex.ESSAY_CLOSING), F.lit(False))


def participial() -> Column:
    return F.filter("sents", lambda s: s.rlike(PARTICIPIAL))


def found(pattern: str) -> Column:
    return F.regexp_extract_all("t", F.lit(pattern), F.lit(0))


EXTRACTED = {"negative": NEGATIVE_PARALLELISM, "answer": SELF_ANSWER, "tricolon": TRICOLON, "sides": BOTH_SIDES, "analogy": ANALOGY, "disclaimer": DISCLAIMER}


def signals() -> dict[str, Column]:
    """What hits and score rest on, as columns ``st_*``."""
    return {
        "st_std": length_std(),
        "st_streaks": streaks(),
        "st_participial": participial(),
        "st_counts": F.transform("para_sents", lambda s: F.size(s).cast("double")),
        "st_fractal": fractal(),
        "st_conclusion": conclusion_overlap(),
        "st_anaphora": anaphora(),
        "st_essay": essay_formula(),
    } | {f"st_{name}": found(p) for name, p in EXTRACTED.items()}


def first_signals() -> dict[str, Column]:
    return {"para_sents": paragraph_sentences()}


def tricolon_flag() -> Column:
    return F.size("st_tricolon") >= F.greatest(F.lit(3), F.floor(F.size("sents") / 8).cast("int"))


def uniform_paragraphs() -> Column:
    return F.coalesce((F.size("paras") >= 3) & (seg.sample_std(F.col("st_counts"), 1) < 1.0) & (seg.mean(F.col("st_counts")) > 2), F.lit(False))


def flags() -> Column:
    """The numerator of the score."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    many = [F.size(f"st_{c}") for c in ("streaks", "participial", "fractal", "anaphora", "negative", "answer", "sides", "analogy", "disclaimer")]
    total = one(F.col("st_std") < LOW_STD) + one(uniform_paragraphs()) + one(F.col("st_conclusion") > 0.4) + one(tricolon_flag()) + one(F.col("st_essay"))
    for n in many:
        total = total + n
    return total


def _located(found_: Column, name: str, longest: int, tail: str = '"') -> Column:
    cut = lambda m: F.substring(m, 1, longest)
    return F.transform(found_, lambda m: F.concat(F.lit("  Line "), seg.find_line(F.col("low_lines"), F.substring(cut(m), 1, 30)), F.lit(f': {name} "'), cut(m), F.lit(tail)))


def hits() -> Column:
    std, p_mean, p_std = F.col("st_std"), seg.mean(F.col("st_counts")), seg.sample_std(F.col("st_counts"), 1)
    average = lambda r: seg.mean(F.slice("sent_words", r["first"], r["n"]))
    span = lambda r: F.concat(F.lit("  Sentences "), r["first"], F.lit("-"), r["first"] + r["n"] - 1, F.lit(": "))
    begins, three = F.col("first_words"), F.col("st_tricolon")
    return F.concat(
        F.when(std < LOW_STD, F.array(F.concat(F.lit("  Burstiness: LOW (std dev "), seg.fixed(std, 1), F.lit(" words) — sentences are too uniform")))).when(std < MODERATE_STD, F.array(F.concat(F.lit("  Burstiness: MODERATE (std dev "), seg.fixed(std, 1), F.lit(" words)")))).otherwise(seg.none()),
        F.transform("st_streaks", lambda r: F.concat(span(r), r["n"], F.lit(" consecutive sentences of ~"), seg.fixed(average(r), 0), F.lit(" words"))),
        F.transform("st_participial", lambda s: F.concat(F.lit("  Line "), seg.find_line(F.col("low_lines"), F.substring(s, 1, 30)), F.lit(': participial ending "...'), F.when(F.length(s) > 60, F.right(s, F.lit(60))).otherwise(s), F.lit('"'))),
        _located(F.col("st_negative"), "negative parallelism", 80),
        _located(F.col("st_answer"), "rhetorical self-answer", 80),
        seg.hit_if(uniform_paragraphs(), F.concat(F.lit("  Paragraph uniformity: avg "), seg.fixed(p_mean, 1), F.lit(" sentences, std dev "), seg.fixed(p_std, 1), F.lit(" — too uniform"))),
        F.transform("st_fractal", lambda r: F.concat(F.lit("  Paragraph "), r["i"], F.lit(": first/last sentence overlap "), seg.fixed(r["x"] * 100, 0), F.lit("% — possible fractal summary"))),
        seg.hit_if(F.coalesce(F.col("st_conclusion") > 0.4, F.lit(False)), F.concat(F.lit("  Conclusion recycling: first/last paragraph overlap "), seg.fixed(F.col("st_conclusion") * 100, 0), F.lit("% — conclusion restates introduction"))),
        F.transform("st_anaphora", lambda r: F.concat(span(r), F.lit("anaphora — "), r["n"], F.lit(' sentences starting with "'), F.get(begins, r["first"] - 1), F.lit('"'))),
        seg.hit_if(tricolon_flag(), F.concat(F.lit("  Tricolon density: "), F.size(three), F.lit(' instances of "X, Y, and Z" — e.g. "'), F.try_element_at(three, F.lit(1)), F.lit('"'))),
        _located(F.col("st_sides"), "balanced counterargument", 80, '..."'),
        _located(F.col("st_analogy"), "analogy stacking", 80, '..."'),
        _located(F.col("st_disclaimer"), "scope disclaimer", 60),
        seg.hit_if(F.col("st_essay"), F.concat(F.lit("  Five-paragraph essay: "), F.size("paras"), F.lit(" paragraphs with intro preview + conclusion formula"))),
    )


def raw() -> Column:
    n = F.size("sents")
    return F.when(n >= 3, F.least(F.lit(1.0), flags() / F.greatest(F.lit(3.0), n / 5))).otherwise(0.0)


def check() -> Column:
    return seg.check(F.when(F.size("sents") >= 3, hits()), raw())
