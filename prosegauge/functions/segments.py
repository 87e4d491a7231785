"""Normalisation and segmentation of texts as Column expressions.

All of them are row-local: no shuffle, no Python, but for ``normalize``, whose
Unicode forms Spark lacks and which is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions.ship import ship

#: White space as Python's str.split() knows it, for Java's regex.
WHITE = r"[\s\x{1c}-\x{1f}]"
_STOP = ""  # stands for a full stop that ends no sentence
# Where lines and sentences end.
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPLIT_SENTENCES = r"(?U)(?<=[.!?])[\"”)]*\s+(?=[A-Z\"“(])"
_ABBREVIATED = r"(?Ui)\b(" + "|".join(a.replace(".", r"\.") for a in lex.ABBREVIATIONS) + r")\."
_FOLD = str.maketrans(lex.LOOK_ALIKE_FROM, lex.LOOK_ALIKE_TO, lex.INVISIBLE)


def normalize_text(text: str) -> str:
    """NFKC, without invisible characters, look-alikes as Latin letters, without marks, recomposed."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return unicodedata.normalize("NFC", bare)


def normalize(text: Column) -> Column:
    """``normalize_text`` of a column; null counts as empty."""
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(normalize_text)

    return folded(F.coalesce(text, F.lit("")))


def normalize_native(text: Column) -> Column:
    """The same inside the JVM for texts of the Latin blocks: one translate over letters that lose a mark, look-alikes and invisible characters."""
    single = {chr(c): n for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(n := normalize_text(chr(c))) == 1 and n != chr(c)}
    source = lex.LOOK_ALIKE_FROM + "".join(single) + "\xa0" + lex.INVISIBLE
    return F.translate(F.coalesce(text, F.lit("")), source, lex.LOOK_ALIKE_TO + "".join(single.values()) + " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{WHITE}+|{WHITE}+\z", "")


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, rf"(?U){WHITE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U)[^\s\x{{1c}}-\x{{1f}}]+"))


def lines(text: Column) -> Column:
    found = F.split(text, _LINE_ENDS, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def alpha_tokens(lower: Column) -> Column:
    """Tokens of a to z between word boundaries, of lower-case text."""
    return F.regexp_extract_all(lower, F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))


def edge_stripped(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(lex.EDGES))


def cleaned(word: Column) -> Column:
    """A word without all but letters, digits, apostrophes, hyphens and inner underscores, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(word, r"(?U)[^\w'-]", ""), F.lit("_")))


def sentences(text: Column) -> Column:
    """Sentences of at least two words; headings' and bullets' marks are dropped, an ellipsis or abbreviation ends none."""
    c = F.regexp_replace(text, r"(?Umd)^#{1,6}\s+", "")
    c = F.regexp_replace(c, r"(?Umd)^[\s]*[-*]\s+", "")
    c = F.replace(c, F.lit("..."), F.lit("…"))
    c = F.regexp_replace(c, _ABBREVIATED, "$1" + _STOP)
    c = F.regexp_replace(c, r"(?<=[A-Z]\.)([A-Z])\.", "$1" + _STOP)
    parts = F.transform(F.split(c, SPLIT_SENTENCES, -1), lambda p: strip(F.replace(p, F.lit(_STOP), F.lit("."))))
    return F.filter(parts, lambda p: n_words(p) >= 2)


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, of at least five words."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n", -1), strip), lambda p: n_words(p) >= 5)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct lower-case words over those of the shorter text."""
    both = F.struct(F.array_distinct(words(F.lower(a))).alias("x"), F.array_distinct(words(F.lower(b))).alias("y"))

    def share(v: Column) -> Column:
        least = F.least(F.size(v["x"]), F.size(v["y"]))
        return F.when(least > 0, F.size(F.array_intersect(v["x"], v["y"])) / least).otherwise(0.0)

    return let(both, share)


def find_line(lower_lines: Column, snippet: Column) -> Column:
    """The number of the first line that holds a snippet, as text; ``?`` if none does."""
    at = F.array_position(F.transform(lower_lines, lambda x: F.contains(x, F.lower(snippet))), F.lit(True))
    return F.when(at > 0, at.cast("string")).otherwise("?")


def mean(values: Column) -> Column:
    """In one fold, so that ``values`` is evaluated once; null for none."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(values, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))


def sample_std(values: Column, least_divisor: int | None = None) -> Column:
    """Standard deviation with n - 1; null for fewer than two values, unless a least divisor is given.

    In one fold, value by value (Welford), as stddev_samp of SQL does: the score has thresholds that whole
    numbers meet exactly, where another order of sums falls on the other side. With a least divisor the sum
    is of squared distances to the mean, as its SQL has it.
    """
    if least_divisor:
        around = lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
        return F.when(F.size(values) > 0, F.sqrt(let(mean(values), around) / F.greatest(F.size(values) - 1, F.lit(least_divisor))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        m = a["m"] + (x - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), m.alias("m"), (a["d"] + (x - m) * (x - a["m"])).alias("d"))

    return F.aggregate(values, zero, step, lambda a: F.when(a["n"] > 0, F.sqrt(F.try_divide(a["d"], a["n"] - 1))))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, half to even."""
    return F.format_string(f"%.{digits}f", F.rint(x * 10**digits) / 10**digits)


def none() -> Column:
    return F.array().cast("array<string>")


def hit_if(condition: Column, text: Column) -> Column:
    """An array with one hit, or none."""
    return F.when(condition, F.array(text)).otherwise(none())


def check(hits: Column, raw: Column) -> Column:
    return F.struct(F.coalesce(hits, none()).alias("hits"), F.coalesce(raw.cast("double"), F.lit(0.0)).alias("raw"))


def segment(df, text: str = "text", native: bool = False):
    """``df`` with the columns that the checks read: t, low, lines, low_lines, words, nw, sents, sent_words, first_words, paras, tokens.

    Columns that lambdas read are made in selects of their own: what a lambda
    refers to more than once is not evaluated again for each element.
    """
    ship(df.sparkSession)
    t = (normalize_native if native else normalize)(F.col(text))
    one = df.withColumn("t", t)
    two = one.withColumns({"low": F.lower("t"), "lines": lines(F.col("t")), "words": words(F.col("t")), "sents": sentences(F.col("t")), "paras": paragraphs(F.col("t"))})
    return two.withColumns({"low_lines": F.transform("lines", F.lower), "nw": F.size("words"), "sent_words": F.transform("sents", lambda s: n_words(s).cast("double")), "first_words": F.transform("sents", lambda s: F.lower(F.regexp_extract(s, r"(?U)^\S+", 0))), "tokens": alpha_tokens(F.col("low"))})
