"""Stock phrases and flagged sentence beginnings.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg
from prosegauge.operators.vocabulary import count_of

PER_100_MAX = 3.0


def phrase_hits() -> Column:
    """A hit for each occurrence: the phrase and up to 20 characters after it. Only phrases found in the text are looked for in its lines."""
    terms = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for c, ps in lex.PHRASES.items() for p in ps])
    present = F.filter(terms, lambda x: F.contains(F.col("low"), x["p"]))

    def of_line(line: Column, i: Column, x: Column) -> Column:
        low = F.lower(line)
        n = count_of(low, x["p"])

        def one(k: Column) -> Column:
            at = F.length(F.call_function("substring_index", low, x["p"], k)) + 1
            return F.concat(F.lit("  Line "), i + 1, F.lit(': "'), F.rtrim(F.substr(line, at, F.length(x["p"]) + 20)), F.lit('..." ['), x["c"], F.lit("]"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)).otherwise(seg.none())

    return F.flatten(F.transform(present, lambda x: F.flatten(F.transform("lines", lambda line, i: of_line(line, i, x)))))


def starter_hits() -> Column:
    starters = F.array(*map(F.lit, lex.STARTERS))

    def of_sentence(s: Column) -> Column:
        found = F.filter(starters, lambda b: F.startswith(F.lower(s), b))
        return F.transform(found, lambda b: F.concat(F.lit("  Line "), seg.find_line(F.col("low_lines"), F.substring(s, 1, 30)), F.lit(': starts with "'), b, F.lit('" [transition]')))

    return F.flatten(F.transform("sents", of_sentence))


def density(n: Column) -> Column:
    """Hits per hundred words as a score; 0 without words (least() would pass over a null)."""
    return F.when(F.col("nw") > 0, F.least(F.lit(1.0), n / (F.col("nw") / 100) / PER_100_MAX)).otherwise(0.0)


def check() -> Column:
    hits = F.concat(phrase_hits(), starter_hits())
    return seg.check(hits, density(F.size(hits)))


def phrase_count() -> Column:
    """Phrases hold no line break, so counting in the whole text equals counting by line."""
    terms = F.array(*[F.lit(p) for ps in lex.PHRASES.values() for p in ps])
    present = F.filter(terms, lambda p: F.contains(F.col("low"), p))
    return F.aggregate(present, F.lit(0), lambda s, p: s + count_of(F.col("low"), p))


def starter_count() -> Column:
    return F.size(F.filter("sents", lambda s: F.lower(s).rlike("^(?:" + "|".join(lex.STARTERS) + ")")))


def raw() -> Column:
    return density(phrase_count() + starter_count())
