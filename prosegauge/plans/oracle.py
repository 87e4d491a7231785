"""The checks in DuckDB SQL, as common table expressions that queries select from.

Written apart from the Spark expressions: joins, windows and unnested rows in
place of row-local folds, and RE2 patterns without lookaround.
"""

from __future__ import annotations

from prosegauge.functions import lexicons as lex
from prosegauge.plans.planted import literal, planted_sql

STOP, CUT = "chr(57344)", "chr(57346)"


def listed(items) -> str:
    return ", ".join(literal(x) for x in items)


WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WHITE}'), lambda w_: w_ <> '')"


def sentences(x: str) -> str:
    c = f"regexp_replace({x}, '(?m)^#{{1,6}}\\s+', '', 'g')"
    c = f"regexp_replace({c}, '(?m)^[\\s]*[-*]\\s+', '', 'g')"
    c = f"replace({c}, '...', chr(8230))"
    short = "|".join(a.replace(".", "\\.") for a in lex.ABBREVIATIONS)
    c = f"regexp_replace({c}, '(?i)(^|[^\\pL\\pN_])({short})\\.', '\\1\\2' || {STOP}, 'g')"
    for _ in range(2):
        c = f"regexp_replace({c}, '([A-Z](?:\\.|' || {STOP} || '))([A-Z])\\.', '\\1\\2' || {STOP}, 'g')"
    c = f"regexp_replace({c}, '([.!?])[\"' || chr(8221) || ')]*\\s+([A-Z\"' || chr(8220) || '(])', '\\1' || {CUT} || '\\2', 'g')"
    parts = f"list_transform(string_split({c}, {CUT}), lambda p_: regexp_replace(regexp_replace(replace(p_, {STOP}, '.'), '^\\s+', ''), '\\s+$', ''))"
    return f"list_filter({parts}, lambda q_: len({words('q_')}) >= 2)"


def overlap(a: str, b: str) -> str:
    x, y = f"list_distinct({words(f'lower({a})')})", f"list_distinct({words(f'lower({b})')})"
    return f"(CASE WHEN least(len({x}), len({y})) > 0 THEN len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) ELSE 0 END)"


def count_of(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {term}, ''))) // length({term}))"


def matches(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, {literal(pattern)}))"


_FORMS = lex.inflected_forms() | {w: w for w in lex.SINGLE_WORDS}
_VOCAB = "SELECT * FROM (VALUES " + ", ".join(f"({literal(f)}, {literal(w)})" for f, w in _FORMS.items()) + ") v(form, lemma)"
_SEVERAL = " + ".join(count_of("low", literal(p)) for p, _ in lex.SEVERAL_WORDS)
_PHRASES = "SELECT * FROM (VALUES " + ", ".join(f"({literal(p)}, {literal(c)})" for c, ps in lex.PHRASES.items() for p in ps) + ") v(phrase, category)"
_WORD = "[\\pL\\pN_]"
PARTICIPIAL = f"(?m),\\s+{_WORD}+ing\\s+[\\pL\\pN_\\s]+[.!?]$"
NEGATIVE = "(?i)(?:it'?s not .{3,40}(?:,|—|-{1,2})\\s*it'?s|it'?s less about .{3,40} and more about|not just .{3,40},?\\s*but also|more than just .{3,40}\\.\\s*it'?s)"
ANSWER = "(?m)(?:^|\\. )(?:The|What|Why|How) [^.?]{3,40}\\?\\s+[A-Z][^.?]{2,40}\\."
TRICOLON = "(?i)([^,]{2,60}),\\s+([^,]{2,60}),?\\s+and\\s+([^,]{2,60})"
SIDES = "(?is)on\\s+(?:the\\s+)?one\\s+hand\\b.*?\\bon\\s+the\\s+other\\s+hand\\b"
ANALOGY = "(?i)just\\s+as\\s+.{10,80}just\\s+as\\s+"
DISCLAIMER = "(?i)(?:this\\s+is\\s+not\\s+(?:an?\\s+)?exhaustive|not\\s+(?:an?\\s+)?exhaustive\\s+(?:list|treatment|analysis|overview)|beyond\\s+the\\s+scope\\s+of\\s+this|space\\s+does\\s+not\\s+permit|there\\s+are[,\\s]+of\\s+course[,\\s]+(?:important\\s+)?(?:caveats|limitations)|this\\s+analysis\\s+has\\s+(?:certain\\s+)?limitations)"


def prelude(table: str = "documents", key: str = "doc_id", columns: str = "doc_id, lang, source") -> str:
    """CTEs up to ``checks``: a row for each document with all signals and raw scores."""
    multi = [h for h in lex.HEDGES if " " in h]
    single = [h for h in lex.HEDGES if " " not in h]
    counted = lambda xs, col: f"len(list_filter({col}, lambda x_: x_ IN ({listed(xs)})))"
    hedges = counted(single, "tokens_u") + "".join(f" + {matches(chr(92) + 'b' + m + chr(92) + 'b', 'low')}" for m in multi)
    conv = " + ".join(matches("(?:^|[^\\pL\\pN_])" + m.replace("?", "\\?"), "low") for m in lex.CONVERSATIONAL)
    marks = ", ".join(f"length(t) - length(replace(t, {literal(c)}, ''))" for c in lex.PUNCTUATION)
    contraction = "(?i)" + _WORD + "+'(?:t|re|ve|ll|d|m)\\b|\\b(?:it|he|she|that|what|there|here|let|who|how|where|when)'s\\b"
    return f"""
WITH base AS (SELECT {columns}, {key} AS k_, {planted_sql(key=key)} AS text FROM {table}),
norm AS (SELECT *, translate(regexp_replace(strip_accents(text), '[' || {literal(lex.INVISIBLE)} || ']', '', 'g'), {literal(lex.LOOK_ALIKE_FROM)}, {literal(lex.LOOK_ALIKE_TO)}) AS t FROM base),
seg0 AS (SELECT *, lower(t) AS low, {words('t')} AS words, {sentences('t')} AS sents,
  regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS lines0,
  list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p_: regexp_replace(regexp_replace(p_, '^\\s+', ''), '\\s+$', '')), lambda q_: len({words('q_')}) >= 5) AS paras
  FROM norm),
seg AS (SELECT *, CASE WHEN lines0[-1] = '' THEN lines0[:-2] ELSE lines0 END AS lines, len(words) AS nw, len(sents) AS ns,
  regexp_split_to_array(low, '[^\\pL\\pN_]+') AS tokens_u,
  list_filter(regexp_split_to_array(low, '[^\\pL\\pN_]+'), lambda x_: regexp_full_match(x_, '[a-z]+')) AS tokens,
  list_transform(words, lambda w_: trim(lower(w_), {literal(lex.EDGES)})) AS bare,
  list_filter(words, lambda w_: regexp_full_match(w_, '\\pL+')) AS alpha,
  list_transform(sents, lambda s_: len({words('s_')})) AS sw,
  list_transform(sents, lambda s_: lower({words('s_')}[1])) AS fw FROM seg0),
vocab AS ({_VOCAB}),
phrases AS ({_PHRASES}),
word_rows AS (SELECT k_, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM seg),
clean_rows AS (SELECT k_, pos, w, lower(trim(regexp_replace(w, '[^\\pL\\pN_''-]', '', 'g'), '_')) AS c FROM word_rows),
vocab_hits AS (SELECT k_, pos, w, lemma FROM clean_rows JOIN vocab ON c = form),
vocab_n AS (SELECT k_, count(*) AS n FROM vocab_hits GROUP BY 1),
phrase_rows AS (SELECT k_, phrase, category, {count_of('low', 'phrase')} AS n FROM seg JOIN phrases ON contains(low, phrase)),
phrase_n AS (SELECT k_, sum(n) AS n FROM phrase_rows GROUP BY 1),
sent_rows AS (SELECT k_, unnest(sw) AS n, unnest(fw) AS f, generate_subscripts(sw, 1) AS i FROM seg),
steps AS (SELECT *, CASE WHEN abs(n - lag(n) OVER w) <= 3 THEN 0 ELSE 1 END AS new_run, CASE WHEN f = lag(f) OVER w THEN 0 ELSE 1 END AS new_word FROM sent_rows WINDOW w AS (PARTITION BY k_ ORDER BY i)),
islands AS (SELECT *, sum(new_run) OVER w AS run, sum(new_word) OVER w AS word_run FROM steps WINDOW w AS (PARTITION BY k_ ORDER BY i ROWS UNBOUNDED PRECEDING)),
streak_rows AS (SELECT k_, run, min(i) AS first, count(*) AS n FROM islands GROUP BY 1, 2 HAVING count(*) >= 3),
streaks AS (SELECT k_, count(*) AS streaks, sum(n) AS streak_sentences FROM streak_rows GROUP BY 1),
anaphora_rows AS (SELECT k_, word_run, min(f) AS f, count(*) AS n FROM islands GROUP BY 1, 2 HAVING count(*) >= 3),
anaphoras AS (SELECT k_, count(*) AS anaphora FROM anaphora_rows WHERE f NOT IN ({listed(lex.ANAPHORA_SKIPPED)}) GROUP BY 1),
stds AS (SELECT k_, stddev_samp(n) AS sent_std, avg(n) AS sent_mean FROM sent_rows GROUP BY 1),
para_rows AS (SELECT k_, unnest(paras) AS p FROM seg),
para_sents AS (SELECT k_, p, {sentences('p')} AS ps FROM para_rows),
para_n AS (SELECT k_, avg(len(ps)) AS p_mean, sqrt(sum((len(ps) - m) * (len(ps) - m)) / greatest(1, count(*) - 1)) AS p_std,
  count(*) FILTER (len(ps) >= 3 AND {overlap('ps[1]', 'ps[-1]')} > 0.5) AS fractal
  FROM (SELECT *, avg(len(ps)) OVER (PARTITION BY k_) AS m FROM para_sents) GROUP BY 1),
token_rows AS (SELECT k_, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS pos FROM seg WHERE len(tokens) >= 50),
gap_rows AS (SELECT k_, w, pos - lag(pos) OVER (PARTITION BY k_, w ORDER BY pos) AS gap FROM token_rows WHERE length(w) >= 5 AND w NOT IN ({listed(lex.BURSTINESS_STOPWORDS)})),
gaps AS (SELECT k_, w, stddev_samp(gap) / avg(gap) AS cv FROM gap_rows GROUP BY 1, 2 HAVING count(gap) >= 2),
bursts AS (SELECT k_, avg(cv) AS burstiness, count(*) AS burst_words FROM gaps GROUP BY 1),
formality AS (SELECT k_, stddev_samp(f) AS f_std FROM (SELECT k_, i, avg(length(w)) AS f FROM (SELECT k_, i, unnest({words('s')}) AS w FROM (SELECT k_, unnest(sents) AS s, generate_subscripts(sents, 1) AS i FROM seg)) GROUP BY 1, 2) GROUP BY 1),
sig AS (SELECT seg.*, coalesce(v.n, 0) AS vocab_single, {_SEVERAL} AS vocab_several, coalesce(p.n, 0) AS phrase_count,
  len(list_filter(sents, lambda s_: regexp_matches(lower(s_), '^(?:{'|'.join(lex.STARTERS)})'))) AS starters,
  sent_std, sent_mean, coalesce(streaks, 0) AS streaks, coalesce(streak_sentences, 0) AS streak_sentences, coalesce(anaphora, 0) AS anaphora,
  p_mean, p_std, coalesce(fractal, 0) AS fractal, burstiness, burst_words, f_std,
  CASE WHEN len(paras) >= 4 THEN {overlap('paras[1]', 'paras[-1]')} END AS conclusion,
  len(paras) >= 4 AND ({' OR '.join(f"contains(lower(paras[1]), {literal(x)})" for x in lex.ESSAY_INTRODUCTION)}) AND ({' OR '.join(f"contains(lower(paras[-1]), {literal(x)})" for x in lex.ESSAY_CLOSING)}) AS essay,
  len(list_filter(sents, lambda s_: regexp_matches(s_, {literal(PARTICIPIAL)}))) AS participial,
  {matches(NEGATIVE)} AS negative, {matches(ANSWER)} AS answer, {matches(TRICOLON)} AS tricolon, {matches(SIDES)} AS sides, {matches(ANALOGY)} AS analogy, {matches(DISCLAIMER)} AS disclaimer,
  length(t) - length(translate(t, '—–', '')) AS long_dashes,
  {matches('(?m)^[\\s]*[-*]\\s+\\*\\*[^*]+\\*\\*')} AS bullets, {matches('(?m)^#{1,6}\\s+')} AS headers, {matches('(?m)^#{1,6}\\s+(?:[A-Z][a-z]+\\s+){2,}[A-Z][a-z]+')} AS titles,
  {hedges} AS hedges, length(t) - length(replace(t, '!', '')) AS exclamations, {counted(lex.ENTHUSIASM, 'tokens_u')} AS enthusiasm, {matches(contraction)} AS contractions,
  len(list_filter(bare, lambda b_: regexp_matches(b_, '(?:tion|ment|ness|ity)$') AND length(b_) > 5 AND b_ NOT IN ({listed(lex.CONCRETE_NOUNS)}))) AS abstract,
  len(alpha) AS n_alpha, list_avg(list_transform(alpha, lambda a_: length(a_))) AS word_length, len(list_filter(alpha, lambda a_: length(a_) > 8))::DOUBLE / nullif(len(alpha), 0) AS long_ratio,
  {counted(lex.INTENSIFIERS, 'bare')} AS intensifiers, {conv} AS conversational, {counted(lex.CONJUNCTIONS, 'fw')} AS conjunctions,
  list_filter([{marks}], lambda m_: m_ > 0) AS marks, list_sum([{marks}]) AS n_marks,
  list_filter(tokens, lambda x_: x_ IN ({listed(lex.CONNECTIVES)})) AS connectives
  FROM seg LEFT JOIN vocab_n v USING (k_) LEFT JOIN phrase_n p USING (k_) LEFT JOIN stds USING (k_) LEFT JOIN streaks USING (k_) LEFT JOIN anaphoras USING (k_)
  LEFT JOIN para_n USING (k_) LEFT JOIN bursts USING (k_) LEFT JOIN formality USING (k_)),
dashes AS (SELECT *, long_dashes + {matches('(?:^|[^\\pL\\pN_])--(?:$|[^\\pL\\pN_])')} AS em FROM sig),
metrics AS (SELECT *,
  CASE WHEN ns >= 10 THEN sent_std / sent_mean END AS cv,
  CASE WHEN n_marks >= 10 THEN -list_sum(list_transform(marks, lambda m_: m_::DOUBLE / n_marks * log2(m_::DOUBLE / n_marks))) END AS entropy,
  CASE WHEN ns >= 3 AND len(tokens) > 0 THEN len(connectives) / (len(tokens) / 100) END AS density,
  (CASE WHEN sent_std < 4 THEN 1 ELSE 0 END) + streaks + participial + negative + answer + (CASE WHEN len(paras) >= 3 AND p_std < 1 AND p_mean > 2 THEN 1 ELSE 0 END) + fractal
   + (CASE WHEN conclusion > 0.4 THEN 1 ELSE 0 END) + anaphora + (CASE WHEN tricolon >= greatest(3, ns // 8) THEN 1 ELSE 0 END) + sides + analogy + disclaimer + (CASE WHEN essay THEN 1 ELSE 0 END) AS flags
  FROM dashes),
parts AS (SELECT *, [
  CASE WHEN nw > 0 THEN [0.15::DOUBLE, least(1, hedges / (nw / 100) / 4)] END,
  CASE WHEN nw > 0 THEN [0.10::DOUBLE, least(1, enthusiasm / 6)] END,
  CASE WHEN nw > 0 THEN [0.10::DOUBLE, least(1, abstract / (nw / 100) / 6)] END,
  CASE WHEN nw > 0 AND n_alpha > 0 THEN [0.10::DOUBLE, least(1, greatest(0, word_length - 4.5) / 1.5)] END,
  CASE WHEN nw > 0 AND n_alpha > 0 THEN [0.08::DOUBLE, least(1, greatest(0, long_ratio - 0.08) / 0.15)] END,
  CASE WHEN nw > 0 THEN [0.08::DOUBLE, least(1, intensifiers / 3)] END,
  CASE WHEN nw > 200 THEN [0.10::DOUBLE, CASE WHEN conversational = 0 THEN 0.5 ELSE 0 END] END,
  CASE WHEN nw > 100 THEN [0.10::DOUBLE, CASE WHEN contractions / (nw / 100) < 0.3 THEN 0.75 ELSE 0 END] END,
  CASE WHEN ns >= 5 THEN [0.10::DOUBLE, CASE WHEN f_std < 0.5 THEN 1 ELSE 0 END] END,
  CASE WHEN ns >= 5 THEN [0.09::DOUBLE, CASE WHEN conjunctions / ns < 0.02 THEN 1 ELSE 0 END] END] AS tone_parts FROM metrics),
raws AS (SELECT *,
  CASE WHEN nw > 0 THEN least(1, (vocab_single + vocab_several) / (nw / 100) / 5) ELSE 0 END::DOUBLE AS r_vocabulary,
  CASE WHEN nw > 0 THEN least(1, (phrase_count + starters) / (nw / 100) / 3) ELSE 0 END::DOUBLE AS r_phrases,
  CASE WHEN ns >= 3 THEN least(1, flags / greatest(3, ns / 5)) ELSE 0 END::DOUBLE AS r_structure,
  coalesce(list_avg(list_filter([CASE WHEN em > 0 AND nw > 0 THEN least(1, em / (nw / 500) / 6) END, CASE WHEN bullets > 0 THEN least(1, bullets / 8) END, CASE WHEN headers > 0 AND nw > 0 THEN least(1, headers / (nw / 500) / 8) END], lambda x_: x_ IS NOT NULL)), 0)::DOUBLE AS r_formatting,
  coalesce(list_sum(list_transform(list_filter(tone_parts, lambda x_: x_ IS NOT NULL), lambda x_: x_[1] * x_[2])) / list_sum(list_transform(list_filter(tone_parts, lambda x_: x_ IS NOT NULL), lambda x_: x_[1])), 0)::DOUBLE AS r_tone,
  CASE WHEN cv IS NULL THEN 0 ELSE greatest(0, least(1, (0.70::DOUBLE - cv) / 0.40::DOUBLE)) END::DOUBLE AS r_rhythm,
  CASE WHEN entropy IS NULL THEN 0 ELSE greatest(0, least(1, (0.60::DOUBLE - entropy / log2(6)) / 0.40::DOUBLE)) END::DOUBLE AS r_punctuation,
  CASE WHEN density IS NULL THEN 0 ELSE greatest(0, least(1, (density - 0.5::DOUBLE) / 3)) END::DOUBLE AS r_connectives,
  CASE WHEN burstiness IS NULL THEN 0 ELSE greatest(0, least(1, (1 - burstiness) / 0.7::DOUBLE)) END::DOUBLE AS r_burstiness FROM parts),
totals AS (SELECT *, r_vocabulary * 0.08::DOUBLE + r_phrases * 0.05::DOUBLE + r_structure * 0.07::DOUBLE + r_tone * 0.15::DOUBLE + r_rhythm * 0.15::DOUBLE + r_punctuation * 0.12::DOUBLE + r_connectives * 0.10::DOUBLE + r_burstiness * 0.08::DOUBLE AS total FROM raws),
checks AS (SELECT *, greatest(0, least(100, round_even(total * 100, 0)::INT)) AS score,
  CASE WHEN round_even(total * 100, 0) <= 20 THEN 'CLEAN' WHEN round_even(total * 100, 0) <= 40 THEN 'MILD' WHEN round_even(total * 100, 0) <= 60 THEN 'NOTICEABLE' WHEN round_even(total * 100, 0) <= 80 THEN 'OBVIOUS' ELSE 'BLATANT' END AS label FROM totals)
"""
