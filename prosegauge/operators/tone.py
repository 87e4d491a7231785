"""Tone: hedging, enthusiasm, formality, word length, intensifiers.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg

# No term of a list is part of another, so one alternation counts what each term alone would.
HEDGE = r"(?U)\b(?:" + "|".join(lex.HEDGES) + r")\b"
ENTHUSIASM = r"(?U)\b(?:" + "|".join(lex.ENTHUSIASM) + r")\b"
CONVERSATIONAL = r"(?U)\b(?:" + "|".join(re.escape(m) for m in lex.CONVERSATIONAL) + ")"
# Fixed value: what counts as a contraction.
CONTRACTION = r"(?Ui)\b\w+'(?:t|re|ve|ll|d|m)\b|\b(?:it|he|she|that|what|there|here|let|who|how|where|when)'s\b"


def signals(df: DataFrame) -> DataFrame:
    """The counts that the check rests on, as columns ``tone_*`` of a segmented frame."""
    low = lambda p: F.regexp_count("low", F.lit(p))
    bare = F.transform("words", seg.edge_stripped)
    alpha = F.filter("words", lambda w: w.rlike(r"^\p{L}+$"))
    sizes = F.transform(alpha, lambda w: F.length(w).cast("double"))
    # the mean length of a sentence's words: its characters but white space, by its words
    formality = F.zip_with("sents", "sent_words", lambda s, n: F.length(F.regexp_replace(s, rf"(?U){seg.WHITE}+", "")) / n)
    one = df.withColumns({"bare": bare, "alpha_sizes": sizes})
    abstract = F.filter("bare", lambda w: w.rlike("(?:tion|ment|ness|ity)$") & (F.length(w) > 5) & ~w.isin(lex.CONCRETE_NOUNS))
    return one.withColumns(
        {
            "tone_hedges": low(HEDGE),
            "tone_exclamations": F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit(""))),
            "tone_enthusiasm": low(ENTHUSIASM),
            "tone_contractions": F.regexp_count("t", F.lit(CONTRACTION)),
            "tone_formality_std": F.when(F.size("sents") >= 5, seg.sample_std(formality)),
            "tone_abstract": F.size(abstract),
            "tone_alpha": F.size("alpha_sizes"),
            "tone_word_length": seg.mean(F.col("alpha_sizes")),
            "tone_long_ratio": F.try_divide(F.size(F.filter("alpha_sizes", lambda n: n > 8)), F.size("alpha_sizes")),
            "tone_intensifiers": F.size(F.filter("bare", lambda w: w.isin(lex.INTENSIFIERS))),
            "tone_conversational": low(CONVERSATIONAL),
            "tone_conjunctions": F.size(F.filter("first_words", lambda w: w.isin(lex.CONJUNCTIONS))),
        }
    )


def _per(n: str, words: int) -> Column:
    return F.try_divide(F.col(n), F.col("nw") / words)


def raw() -> Column:
    """The weighted mean of the signals that the text is long enough for."""
    n, s = F.col("nw"), F.size("sents")
    c = F.col
    least = lambda x: F.least(F.lit(1.0), x)
    over = lambda x: F.greatest(F.lit(0.0), x)
    some, alpha = n > 0, c("tone_alpha") > 0
    parts = [
        (0.15, least(_per("tone_hedges", 100) / 4), some),
        (0.10, least(c("tone_enthusiasm") / 6), some),
        (0.10, least(_per("tone_abstract", 100) / 6), some),
        (0.10, least(over(c("tone_word_length") - 4.5) / 1.5), some & alpha),
        (0.08, least(over(c("tone_long_ratio") - 0.08) / 0.15), some & alpha),
        (0.08, least(c("tone_intensifiers") / 3), some),
        (0.10, F.when(c("tone_conversational") == 0, 0.5).otherwise(0.0), n > 200),
        (0.10, F.when(_per("tone_contractions", 100) < 0.3, 0.75).otherwise(0.0), n > 100),
        (0.10, F.when(c("tone_formality_std") < 0.5, 1.0).otherwise(0.0), s >= 5),
        (0.09, F.when(F.try_divide(c("tone_conjunctions"), s) < 0.02, 1.0).otherwise(0.0), s >= 5),
    ]
    used = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(w).alias("w"), v.cast("double").alias("v"))) for w, v, when in parts]))
    total = F.aggregate(used, F.lit(0.0), lambda a, x: a + x["w"] * x["v"])
    return F.coalesce(F.try_divide(total, F.aggregate(used, F.lit(0.0), lambda a, x: a + x["w"])), F.lit(0.0))


def hits() -> Column:
    c, n, s = F.col, F.col("nw"), F.size("sents")
    yes = lambda x: F.coalesce(x, F.lit(False))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    none = seg.none()
    hedge, enth, abstract, intense = _per("tone_hedges", 100), _per("tone_enthusiasm", 500), _per("tone_abstract", 100), _per("tone_intensifiers", 500)
    names = F.array_join(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("low", F.lit(ENTHUSIASM), F.lit(0)))), 1, 5), ", ")
    strong = F.array_join(F.array_sort(F.array_distinct(F.slice(F.filter("bare", lambda w: w.isin(lex.INTENSIFIERS)), 1, 5))), ", ")
    return F.concat(
        F.when(hedge > 2, F.array(text("  Hedging density: ", seg.fixed(hedge, 1), " per 100 words (high)"))).when(hedge > 1, F.array(text("  Hedging density: ", seg.fixed(hedge, 1), " per 100 words (moderate)"))).otherwise(none),
        seg.hit_if(yes(_per("tone_exclamations", 500) > 3), text("  Exclamation marks: ", c("tone_exclamations"), " total (", seg.fixed(_per("tone_exclamations", 500), 1), " per 500 words)")),
        F.when(enth > 2, F.array(text("  False enthusiasm: ", c("tone_enthusiasm"), " hype words (", seg.fixed(enth, 1), " per 500 words) — ", names))).when((n > 0) & (c("tone_enthusiasm") >= 3), F.array(text("  Enthusiasm: ", c("tone_enthusiasm"), " instances — ", names))).otherwise(none),
        seg.hit_if(yes((n > 100) & (_per("tone_contractions", 100) < 0.3)), text("  Low contraction rate: ", c("tone_contractions"), " contractions in ", n, " words (", seg.fixed(_per("tone_contractions", 100), 2), "/100) — overly formal")),
        seg.hit_if(yes(c("tone_formality_std") < 0.5), text("  Register consistency: formality std dev ", seg.fixed(c("tone_formality_std"), 2), " — tone is unnaturally uniform (human writing varies more)")),
        F.when(abstract > 3, F.array(text("  Abstract noun density: ", seg.fixed(abstract, 1), " per 100 words (high) — overuse of -tion/-ment/-ness/-ity words"))).when(abstract > 1.5, F.array(text("  Abstract noun density: ", seg.fixed(abstract, 1), " per 100 words (moderate)"))).otherwise(none),
        seg.hit_if(yes(c("tone_word_length") > 5.2), text("  Average word length: ", seg.fixed(c("tone_word_length"), 1), " chars (high) — AI averages 5.3-5.8, humans 4.0-4.5")),
        seg.hit_if(yes(c("tone_long_ratio") > 0.12), text("  Long word ratio: ", seg.fixed(c("tone_long_ratio") * 100, 0), "% of words >8 chars (AI typical: 18-24%, human: 3-7%)")),
        seg.hit_if(yes(intense > 1), text("  Intensifier density: ", seg.fixed(intense, 1), " per 500 words — ", strong)),
        seg.hit_if((n > 200) & (c("tone_conversational") == 0), text("  No conversational markers found in ", n, " words — natural writing uses 'actually', 'honestly', 'turns out', etc.")),
        seg.hit_if(yes((s >= 5) & (F.try_divide(c("tone_conjunctions"), s) < 0.02)), text("  No conjunction starters: 0/", s, " sentences start with And/But/So — human writing does this naturally")),
    )


def check() -> Column:
    return seg.check(hits(), raw())
