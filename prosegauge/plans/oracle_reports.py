"""Hits and reports in DuckDB SQL, from the rows of ``oracle``'s common table expressions.

A hit is a row with its check and three numbers that order it within the check;
a report strings the hits of a document together.
"""

from __future__ import annotations

from prosegauge.functions import lexicons as lex
from prosegauge.operators import structure
from prosegauge.plans import oracle
from prosegauge.plans.planted import literal

#: The raw score of each check in ``checks``.
RAW = {"vocabulary": "r_vocabulary", "phrases": "r_phrases", "structure": "r_structure", "formatting": "r_formatting", "tone": "r_tone", "compression": "0::DOUBLE", "sentence_rhythm": "r_rhythm", "punctuation": "r_punctuation", "connectives": "r_connectives", "burstiness": "r_burstiness"}
ENTHUSIASM = "(?:" + "|".join(lex.ENTHUSIASM) + ")"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even(({x}) * {10**digits}, 0) / {10**digits})"


def text(*parts: str | tuple) -> str:
    """SQL that joins literal strings and, in tuples, expressions."""
    return " || ".join(literal(p) if isinstance(p, str) else f"({p[0]})::VARCHAR" for p in parts)


def line_of(snippet: str) -> str:
    return f"coalesce(nullif(list_position(list_transform(lines, lambda l_: contains(lower(l_), lower({snippet}))), true), 0)::VARCHAR, '?')"


def _case(*cases: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in cases) + " END"


def _extracted(place: int, pattern: str, name: str, longest: int, tail: str = '"') -> str:
    cut = f"substr(m, 1, {longest})"
    said = text("  Line ", (line_of(f"substr({cut}, 1, 30)"),), f': {name} "', (cut,), tail)
    return f"SELECT k_, 'structure', {place}, i, 0, {said} FROM (SELECT k_, lines, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT k_, lines, regexp_extract_all(t, {literal(pattern)}) AS ms FROM checks WHERE ns >= 3))"


def _single(check: str, place: int, said: str, where: str = "true") -> str:
    return f"SELECT k_, '{check}', {place}, 0, 0, {said} FROM checks WHERE {where}"


def _tone() -> list[str]:
    per = lambda n, words: f"({n} / (nw / {words}::DOUBLE))"
    hedge, enth, abstract, intense, contr, excl = per("hedges", 100), per("enthusiasm", 500), per("abstract", 100), per("intensifiers", 500), per("contractions", 100), per("exclamations", 500)
    names = f"array_to_string(list_sort(list_distinct(list_filter(tokens_u, lambda x_: regexp_full_match(x_, '{ENTHUSIASM}'))))[:5], ', ')"
    strong = f"array_to_string(list_sort(list_distinct(list_filter(bare, lambda x_: x_ IN ({oracle.listed(lex.INTENSIFIERS)}))[:5])), ', ')"
    some = "nw > 0 AND "
    return [
        _case((f"{hedge} > 2", text("  Hedging density: ", (fixed(hedge, 1),), " per 100 words (high)")), (f"{hedge} > 1", text("  Hedging density: ", (fixed(hedge, 1),), " per 100 words (moderate)"))),
        _case((f"{some}{excl} > 3", text("  Exclamation marks: ", ("exclamations",), " total (", (fixed(excl, 1),), " per 500 words)"))),
        _case((f"{some}{enth} > 2", text("  False enthusiasm: ", ("enthusiasm",), " hype words (", (fixed(enth, 1),), " per 500 words) — ", (names,))), (f"{some}enthusiasm >= 3", text("  Enthusiasm: ", ("enthusiasm",), " instances — ", (names,)))),
        _case((f"nw > 100 AND {contr} < 0.3", text("  Low contraction rate: ", ("contractions",), " contractions in ", ("nw",), " words (", (fixed(contr, 2),), "/100) — overly formal"))),
        _case(("ns >= 5 AND f_std < 0.5", text("  Register consistency: formality std dev ", (fixed("f_std", 2),), " — tone is unnaturally uniform (human writing varies more)"))),
        _case((f"{some}{abstract} > 3", text("  Abstract noun density: ", (fixed(abstract, 1),), " per 100 words (high) — overuse of -tion/-ment/-ness/-ity words")), (f"{some}{abstract} > 1.5", text("  Abstract noun density: ", (fixed(abstract, 1),), " per 100 words (moderate)"))),
        _case(("word_length > 5.2", text("  Average word length: ", (fixed("word_length", 1),), " chars (high) — AI averages 5.3-5.8, humans 4.0-4.5"))),
        _case(("long_ratio > 0.12", text("  Long word ratio: ", (fixed("long_ratio * 100", 0),), "% of words >8 chars (AI typical: 18-24%, human: 3-7%)"))),
        _case((f"{some}{intense} > 1", text("  Intensifier density: ", (fixed(intense, 1),), " per 500 words — ", (strong,)))),
        _case(("nw > 200 AND conversational = 0", text("  No conversational markers found in ", ("nw",), " words — natural writing uses 'actually', 'honestly', 'turns out', etc."))),
        _case(("ns >= 5 AND conjunctions / ns < 0.02", text("  No conjunction starters: 0/", ("ns",), " sentences start with And/But/So — human writing does this naturally"))),
    ]


def hits() -> str:
    """CTEs up to ``hit_rows``: k_, chk, a, b, c, hit."""
    per = "(em / (nw / 500::DOUBLE))"
    heads = "(headers / (nw / 500::DOUBLE))"
    share = "(entropy / log2(6))"
    span = lambda tail: ("  Sentences ", ("first",), "-", ("first + n - 1",), ": ", *tail)
    named = lambda check, value, cases, lead, digits, unit="": _case(*[(c, text(lead, (fixed(value, digits),), f"{unit} ({how})" + tail)) for c, how, tail in cases])  # noqa: E731, ARG005
    context = "array_to_string(ws[greatest(j - 5, 1) : least(j + 5, len(ws))], ' ')"
    before = "regexp_extract(context, '(?is)^(.*?)\\b' || regexp_escape(w) || '\\b', 1)"
    capital = f"CASE WHEN regexp_matches(context, '(?is)\\b' || regexp_escape(w) || '\\b') THEN {before} || upper(substr(context, length({before}) + 1, length(w))) || substr(context, length({before}) + length(w) + 1) ELSE context END"
    several = ", ".join(f"({i}, {literal(p)}, {literal(c)})" for i, (p, c) in enumerate(lex.SEVERAL_WORDS))
    phrases = ", ".join(f"({i}, {literal(p)}, {literal(c)})" for i, (p, c) in enumerate((p, c) for c, ps in lex.PHRASES.items() for p in ps))
    starters = ", ".join(f"({i}, {literal(s)})" for i, s in enumerate(lex.STARTERS))
    snippet = "rtrim(substr(line, (list_sum(list_transform(string_split(lower(line), p)[1 : r], lambda x_: length(x_))) + (r - 1) * length(p) + 1)::BIGINT, length(p) + 20), ' ')"
    low_std, moderate = structure.LOW_STD, structure.MODERATE_STD
    unions = [
        f"SELECT k_, 'vocabulary', 0, ln, j, {text('  Line ', ('ln',), ': "...', (capital,), '..." [', ('lemma',), ']')} FROM (SELECT *, {context} AS context FROM line_words JOIN vocab ON c = form)",
        f"SELECT k_, 'vocabulary', 1 + i, ln, r, {text('  Line ', ('ln',), ': "', ('p',), '" [', ('c',), ']')} FROM (SELECT k_, i, ln, p, c, unnest(range({oracle.count_of('lower(line)', 'p')})) AS r FROM line_rows JOIN (VALUES {several}) v(i, p, c) ON contains(lower(line), p))",
        f"SELECT k_, 'phrases', i, ln, r, {text('  Line ', ('ln',), ': "', (snippet,), '..." [', ('c',), ']')} FROM (SELECT k_, i, ln, line, p, c, unnest(range(1, {oracle.count_of('lower(line)', 'p')} + 1)) AS r FROM line_rows JOIN (VALUES {phrases}) v(i, p, c) ON contains(lower(line), p))",
        f"SELECT k_, 'phrases', 1000, s_i, i, {text('  Line ', (line_of('substr(s, 1, 30)'),), ': starts with "', ('b',), '" [transition]')} FROM sentence_rows JOIN (VALUES {starters}) v(i, b) ON starts_with(lower(s), b)",
        _single("structure", 1, _case((f"sent_std < {low_std}", text("  Burstiness: LOW (std dev ", (fixed("sent_std", 1),), " words) — sentences are too uniform")), (f"sent_std < {moderate}", text("  Burstiness: MODERATE (std dev ", (fixed("sent_std", 1),), " words)"))), "ns >= 3"),
        f"SELECT k_, 'structure', 2, first, 0, {text(*span((('n',), ' consecutive sentences of ~', (fixed('mean', 0),), ' words')))} FROM (SELECT k_, run, min(i) AS first, count(*) AS n, avg(n) AS mean FROM islands GROUP BY 1, 2 HAVING count(*) >= 3) JOIN checks USING (k_) WHERE ns >= 3".replace("checks USING", "(SELECT k_, ns FROM checks) USING"),
        f"SELECT k_, 'structure', 3, s_i, 0, {text('  Line ', (line_of('substr(s, 1, 30)'),), ': participial ending "...', ('CASE WHEN length(s) > 60 THEN right(s, 60) ELSE s END',), '"')} FROM sentence_rows WHERE ns >= 3 AND regexp_matches(s, {literal(oracle.PARTICIPIAL)})",
        _extracted(4, oracle.NEGATIVE, "negative parallelism", 80),
        _extracted(5, oracle.ANSWER, "rhetorical self-answer", 80),
        _single("structure", 6, text("  Paragraph uniformity: avg ", (fixed("p_mean", 1),), " sentences, std dev ", (fixed("p_std", 1),), " — too uniform"), "ns >= 3 AND len(paras) >= 3 AND p_std < 1 AND p_mean > 2"),
        f"SELECT k_, 'structure', 7, p_i, 0, {text('  Paragraph ', ('p_i',), ': first/last sentence overlap ', (fixed('x * 100', 0),), '% — possible fractal summary')} FROM (SELECT k_, ns, p_i, {oracle.overlap('ps[1]', 'ps[-1]')} AS x FROM (SELECT k_, ns, p_i, {oracle.sentences('p')} AS ps FROM (SELECT k_, ns, unnest(paras) AS p, generate_subscripts(paras, 1) AS p_i FROM checks)) WHERE len(ps) >= 3) WHERE ns >= 3 AND x > 0.5",
        _single("structure", 8, text("  Conclusion recycling: first/last paragraph overlap ", (fixed("conclusion * 100", 0),), "% — conclusion restates introduction"), "ns >= 3 AND conclusion > 0.4"),
        f"SELECT k_, 'structure', 9, first, 0, {text(*span(('anaphora — ', ('n',), ' sentences starting with "', ('f',), '"')))} FROM (SELECT k_, word_run, min(i) AS first, min(f) AS f, count(*) AS n FROM islands GROUP BY 1, 2 HAVING count(*) >= 3) WHERE f NOT IN ({oracle.listed(lex.ANAPHORA_SKIPPED)})",
        _single("structure", 10, text("  Tricolon density: ", ("tricolon",), ' instances of "X, Y, and Z" — e.g. "', (f"regexp_extract_all(t, {literal(oracle.TRICOLON)})[1]",), '"'), "ns >= 3 AND tricolon >= greatest(3, ns // 8)"),
        _extracted(11, oracle.SIDES, "balanced counterargument", 80, '..."'),
        _extracted(12, oracle.ANALOGY, "analogy stacking", 80, '..."'),
        _extracted(13, oracle.DISCLAIMER, "scope disclaimer", 60),
        _single("structure", 14, text("  Five-paragraph essay: ", ("len(paras)",), " paragraphs with intro preview + conclusion formula"), "ns >= 3 AND coalesce(essay, false)"),
        _single("formatting", 1, text("  Em dash density: ", (fixed(per, 1),), " per 500 words (limit: 2) — ", ("em",), " total"), f"nw > 0 AND {per} > 2"),
        _single("formatting", 2, text("  Bold-first bullets: ", ("bullets",), " instances"), "bullets >= 3"),
        _single("formatting", 3, _case(("nw > 0 AND nw < 500 AND headers > 3", text("  Header density: ", ("headers",), " headers in ", ("nw",), " words — excessive")), (f"nw > 0 AND {heads} > 4", text("  Header density: ", (fixed(heads, 1),), " per 500 words — excessive")))),
        _single("formatting", 4, text("  Title Case headers: ", ("titles",), " instances (prefer sentence case)"), "titles > 0"),
        *[_single("tone", i, said) for i, said in enumerate(_tone())],
        _single("sentence_rhythm", 0, named("", "cv", [("cv < 0.35", "very low", " — sentence lengths are unnaturally uniform"), ("cv < 0.50", "low", " — sentence lengths lack natural variation")], "  Sentence rhythm: CV=", 2)),
        _single("punctuation", 0, named("", "entropy", [(f"{share} < 0.30", "very low", " — almost only commas and periods"), (f"{share} < 0.45", "low", " — limited punctuation variety")], "  Punctuation diversity: entropy=", 2)),
        _single("connectives", 0, _case(*[(f"density > {least}", text("  Connective density: ", (fixed("density", 1),), f" per 100 words ({how}) — ", ("array_to_string(list_transform(list_sort(list_transform(list_distinct(connectives), lambda w_: {'p': list_position(connectives, w_), 'w': w_}))[:5], lambda x_: x_.w), ', ')",))) for least, how in ((3.0, "high"), (1.5, "moderate"))])),
        _single("burstiness", 0, named("", "burstiness", [("burstiness < 0.5", "very low", " — content words are distributed too evenly"), ("burstiness < 0.7", "low", " — content words lack natural clustering")], "  Word burstiness: ", 2)),
    ]
    return (
        oracle.prelude()
        + f""",
line_rows AS (SELECT k_, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM checks),
line_words AS (SELECT *, lower(trim(regexp_replace(w, '[^\\pL\\pN_''-]', '', 'g'), '_')) AS c FROM (SELECT k_, ln, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM (SELECT k_, ln, {oracle.words('line')} AS ws FROM line_rows))),
sentence_rows AS (SELECT k_, ns, lines, unnest(sents) AS s, generate_subscripts(sents, 1) AS s_i FROM checks),
hit_rows(k_, chk, a, b, c, hit) AS (SELECT * FROM ({' UNION ALL '.join(unions)}) x(k_, chk, a, b, c, hit) WHERE hit IS NOT NULL)
"""
    )


def hit_texts() -> str:
    return hits() + "SELECT doc_id, chk AS \"check\", (row_number() OVER (PARTITION BY k_, chk ORDER BY a, b, c) - 1)::BIGINT AS place, hit FROM hit_rows JOIN (SELECT k_, doc_id FROM base) USING (k_)"


def _grouped() -> str:
    return hits() + ", by_check AS (SELECT k_, chk, list(hit ORDER BY a, b, c) AS hs FROM hit_rows GROUP BY 1, 2), hit_map AS (SELECT k_, map_from_entries(list((chk, hs))) AS hm FROM by_check GROUP BY 1), scored AS (SELECT checks.*, coalesce(hm, MAP {}) AS hm FROM checks LEFT JOIN hit_map USING (k_))"


def _of(check: str) -> str:
    return f"coalesce(hm['{check}'], [])"


def _hits(check: str) -> str:
    return f"len({_of(check)}) || CASE WHEN len({_of(check)}) = 1 THEN ' hit' ELSE ' hits' END"


def console(title: str = "Style score") -> str:
    newline = "chr(10)"
    parts = [f"{newline} || {text(f'{title}: ', ('score',), '/100 [', ('label',), ']')} || {newline}"]
    for k in lex.DISPLAY_ORDER:
        clean = f"{literal(f'=== {lex.SECTIONS[k]} — clean ===')} || {newline}"
        parts.append(f"CASE WHEN len({_of(k)}) = 0 THEN {clean} ELSE {text(f'=== {lex.SECTIONS[k]} (', (_hits(k),), ') ===')} || {newline} || array_to_string({_of(k)}, {newline}) || {newline} END")
    summary = " || ' | ' || ".join(text(f"{lex.SUMMARY_NAMES[k]}: ", (f"len({_of(k)})",)) for k in lex.DISPLAY_ORDER)
    parts.append(f"'=== Summary: ' || {summary} || ' ==='")
    return _grouped() + f" SELECT doc_id, concat_ws({newline}, {', '.join(parts)}) AS report FROM scored"


def markdown(statistics: str, title: str = "Style Report") -> str:
    """``statistics``: the figures of the raw texts, as ``(doc_id, words, sentences, ...)`` in common table expressions named ``figures``."""
    newline = "chr(10)"
    strip = "regexp_replace(regexp_replace(h_, '^\\s+', ''), '\\s+$', '')"
    lines = [text(f"# {title}: document ", ("doc_id",)), "''", text("**Score: ", ("score",), "/100 [", ("label",), "]**"), "''", f"'`[' || repeat('#', score // 5) || repeat('.', 20 - score // 5) || ']` ' || score || '/100'", "''", "'## Score Breakdown'", "''", "'| Category | Hits | Raw Score | Weight | Weighted |'", "'|----------|------|-----------|--------|----------|'"]
    for k in lex.DISPLAY_ORDER:
        weight = lex.WEIGHTS[k]
        lines.append(text(f"| {lex.SECTIONS[k]} | ", (f"len({_of(k)})",), " | ", (fixed(RAW[k], 2),), f" | {weight:.0%} | ", (fixed(f"{RAW[k]} * {weight}::DOUBLE", 2),), " |"))
    lines += ["''", "'## Text Statistics'", "''", "'| Metric | Value |'", "'|--------|-------|'"]
    for name, value, tail in (("Words", "words_", ""), ("Sentences", "sentences_", ""), ("Paragraphs", "paragraphs_", ""), ("Avg word length", fixed("word_length_", 1), " chars"), ("Burstiness (sentence length std dev)", fixed("sentence_std_", 1), ""), ("Lexical diversity (type-token ratio)", fixed("variety_", 2), ""), ("Unique words", "unique_words_", "")):
        lines.append(text(f"| {name} | ", (value,), f"{tail} |"))
    lines.append("''")
    issues = "flatten([" + ", ".join(f"list_transform({_of(k)}, lambda h_: {literal(f'- **{lex.SECTIONS[k]}**: ')} || {strip})" for k in lex.DISPLAY_ORDER) + "])"
    lines.append(f"CASE WHEN len({issues}) > 0 THEN '## Top Issues' || {newline} || {newline} || array_to_string({issues}, {newline}) || {newline} END")
    lines += [f"'## Detailed Findings' || {newline}"]
    for k in lex.DISPLAY_ORDER:
        found = f"CASE WHEN len({_of(k)}) = 0 THEN 'No issues found.' ELSE array_to_string(list_transform({_of(k)}, lambda h_: '- `' || {strip} || '`'), {newline}) END"
        lines.append(f"{text(f'### {lex.SECTIONS[k]} (', (_hits(k),), ')')} || {newline} || {newline} || {found} || {newline}")
    lines.append("'---'")
    own = _grouped() + f", figures AS (SELECT doc_id, words AS words_, sentences AS sentences_, paragraphs AS paragraphs_, word_length AS word_length_, sentence_std AS sentence_std_, variety AS variety_, unique_words AS unique_words_ FROM ({statistics}))"
    return own + f" SELECT doc_id, concat_ws({newline}, {', '.join(lines)}) AS report FROM scored JOIN figures USING (doc_id)"
