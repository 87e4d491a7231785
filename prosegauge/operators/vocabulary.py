"""Overused words, exact, inflected, or of several words.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg

PER_100_MAX = 5.0
_FORMS = lex.inflected_forms() | {w: w for w in lex.SINGLE_WORDS}


def lemma(word: Column) -> Column:
    """The listed word of a cleaned word, exact or inflected, else null. The set test is hashed; the map is read for hits alone."""
    forms = F.map_from_arrays(F.split(F.lit(" ".join(_FORMS)), " "), F.split(F.lit(" ".join(_FORMS.values())), " "))
    return F.when(word.isin(list(_FORMS)), F.try_element_at(forms, word))


def listed(words: Column) -> Column:
    """The places (from 1), words and lemmas of a line's listed words."""
    placed = F.transform(words, lambda w, j: F.struct((j + 1).alias("j"), w.alias("w"), seg.cleaned(w).alias("c")))
    return F.transform(F.filter(placed, lambda x: x["c"].isin(list(_FORMS))), lambda x: F.struct(x["j"].alias("j"), x["w"].alias("w"), lemma(x["c"]).alias("lemma")))


def in_context(words: Column, j: Column, word: Column) -> Column:
    """Five words on either side, the word itself in capitals where it stands as a word first."""
    first = F.greatest(j - 5, F.lit(1))
    context = F.array_join(F.slice(words, first, F.least(j + 5, F.size(words)) - first + 1), " ")
    at = F.regexp_instr(context, F.concat(F.lit(r"(?Ui)\b\Q"), word, F.lit(r"\E\b")))
    return F.when(at > 0, F.concat(F.substr(context, F.lit(1), at - 1), F.upper(F.substr(context, at, F.length(word))), F.substr(context, at + F.length(word)))).otherwise(context)


def single_hits() -> Column:
    def of_line(line: Column, i: Column) -> Column:
        words = seg.words(line)
        return F.transform(listed(words), lambda x: F.concat(F.lit("  Line "), i + 1, F.lit(': "...'), in_context(words, x["j"], x["w"]), F.lit('..." ['), x["lemma"], F.lit("]")))

    return F.flatten(F.transform("lines", of_line))


def count_of(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def several_hits() -> Column:
    terms = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in lex.SEVERAL_WORDS])
    present = F.filter(terms, lambda x: F.contains(F.col("low"), x["p"]))
    return F.flatten(F.transform(present, lambda x: F.flatten(F.transform("low_lines", lambda line, i: F.array_repeat(F.concat(F.lit("  Line "), i + 1, F.lit(': "'), x["p"], F.lit('" ['), x["c"], F.lit("]")), count_of(line, x["p"]))))))


def density(n: Column) -> Column:
    """Hits per hundred words as a score; 0 without words (least() would pass over a null)."""
    return F.when(F.col("nw") > 0, F.least(F.lit(1.0), n / (F.col("nw") / 100) / PER_100_MAX)).otherwise(0.0)


def check() -> Column:
    hits = F.concat(single_hits(), several_hits())
    return seg.check(hits, density(F.size(hits)))


def single_count() -> Column:
    """How many words are listed ones; lines don't matter, as no word crosses one."""
    # the list as text: thousands of literals built one by one from Python cost more than the query on a small table
    return F.expr("size(filter(vo_clean, w -> w in (" + ", ".join(f"'{w}'" for w in _FORMS) + ")))")


def signals() -> dict[str, Column]:
    return {"vo_clean": F.transform("words", seg.cleaned)}


def several_count() -> Column:
    out = None
    for p, _ in lex.SEVERAL_WORDS:
        term = count_of(F.col("low"), F.lit(p))
        out = term if out is None else out + term
    return out


def raw() -> Column:
    return density(single_count() + several_count())
