import re
import unicodedata

from pyspark.sql import functions as F

from prosegauge.functions import segments as seg

CASES = [
    "", "one", "Dr. Smith met Mr. Jones. They spoke, e.g. about rain.", "He lives in the U.S.A. today. She left D.C. early. A.B.C. is it.",
    "# Heading one\n- bullet text here\n* another bullet\nPlain text. Next one begins.", 'He said "go." Then he left. (Maybe not.) "Quote" starts.',
    "Wait... what is this? Nothing else! Ok then.", "One.\n\nTwo three four five six. Seven eight.\n\n  \nshort para", "a\r\nb\x0bc\x85d\u2028e\n", "A. B. C. Dd ee. F gg.",
    "Caf\u00e9 na\u00efve \u0430pple \u1d0d\u0262 ze\u200bro \uff21\uff22 \u0451 \u00df \u2026 x\u00a0y",
]


#: Written by hand: what a reader of the rules takes for the sentences of each case.
SENTENCES = [
    [],
    [],
    ["Dr. Smith met Mr. Jones.", "They spoke, e.g. about rain."],
    ["He lives in the U.S.A. today.", "She left D.C. early.", "A.B.C. is it."],
    ["Heading one\nbullet text here\nanother bullet\nPlain text.", "Next one begins."],
    ['He said "go.', "Then he left.", "(Maybe not.", '"Quote" starts.'],
    ["Wait\u2026 what is this?", "Nothing else!", "Ok then."],
    ["Two three four five six.", "Seven eight.\n\n  \nshort para"],
    ["a\r\nb\x0bc\x85d\u2028e"],
    ["Dd ee.", "F gg."],
    ["Caf\u00e9 na\u00efve \u0430pple \u1d0d\u0262 ze\u200bro \uff21\uff22 \u0451 \u00df \u2026 x\u00a0y"],
]


def rows(df, column):
    return [r[0] for r in df.orderBy("doc_id").select(column).collect()]


def test_sentences(texts):
    assert rows(texts(*CASES), seg.sentences(F.col("text"))) == SENTENCES


def test_words_lines_paragraphs(texts):
    df = texts(*CASES)
    assert rows(df, seg.words(F.col("text"))) == [t.split() for t in CASES]
    assert rows(df, seg.n_words(F.col("text"))) == [len(t.split()) for t in CASES]
    assert rows(df, seg.lines(F.col("text"))) == [t.splitlines() for t in CASES]
    assert rows(df, seg.paragraphs(F.col("text"))) == [[p.strip() for p in re.split(r"\n\s*\n", t) if len(p.split()) >= 5] for t in CASES]
    assert rows(df, seg.alpha_tokens(F.lower("text"))) == [re.findall(r"\b[a-z]+\b", t.lower()) for t in CASES]


def test_normalize(texts):
    for t, got in zip(CASES, rows(texts(*CASES), seg.normalize(F.col("text"))), strict=True):
        assert got == seg.normalize_text(t)
        assert not any(unicodedata.category(c).startswith("M") for c in got)
    assert seg.normalize_text("\u0430\u200b\u00e9") == "ae" and seg.normalize_text("\u0451") == "\u0435"


def test_overlap_and_find_line(spark):
    df = spark.createDataFrame([("a b c", "B d", ["xx", "Yb"])], "a string, b string, l array<string>")
    r = df.select(seg.overlap(F.col("a"), F.col("b")), seg.overlap(F.lit(""), F.col("b")), seg.find_line(F.transform("l", F.lower), F.lit("yB")), seg.find_line(F.col("l"), F.lit("zz"))).first()
    assert list(r) == [0.5, 0.0, "2", "?"]
