from prosegauge.functions import lexicons as lex


def test_sizes():
    assert [len(v) for v in lex.OVERUSED.values()] == [29, 32, 18, 12, 7]
    assert len(lex.SINGLE_WORDS) == 95 and len(lex.SEVERAL_WORDS) == 5
    assert sum(map(len, lex.PHRASES.values())) == 71 and len(lex.STARTERS) == 7
    assert len(lex.ENTHUSIASM) == 19 and len(lex.HEDGES) == 15 and len(lex.CONNECTIVES) == 22
    assert len(lex.SUFFIXES) == 29 and len(lex.CONCRETE_NOUNS) == 89 and len(lex.BURSTINESS_STOPWORDS) == 52
    assert len(lex.LOOK_ALIKE_FROM) == len(lex.LOOK_ALIKE_TO) == 64 and len(lex.INVISIBLE) == 13 and len(lex.ABBREVIATIONS) == 38
    assert abs(sum(lex.WEIGHTS.values()) - 1) < 1e-12


def test_inflected_forms():
    forms = lex.inflected_forms()
    assert forms["leveraging"] == "leverage" and forms["delves"] == "delve" and forms["unlocking"] == "unlock"
    assert "feature" not in forms and "marked" not in forms  # only "features" and "marks" are listed
    assert not set(forms) & set(lex.SINGLE_WORDS)
