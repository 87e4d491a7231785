"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from prosegauge.llm import quality_rules as q


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "-]\\^" else f"\\x{ord(c):02x}" if c < " " else "''" if c == "'" else c for c in chars)


def divergence() -> str:
    """Counts and verdict of the quality rules, by unnested windows and histograms as lists."""
    count = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
    named = [count(_class(c)) for c in q.KINDS.values()]
    beyond = "length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"
    other = f"length(t) - {beyond} - " + " - ".join(named)
    cases = " ".join(f"WHEN '{lang}' THEN list_transform({_list(words)}, lambda c: len(list_filter(lw, lambda x: x = c)))" for lang, words in q.COMMON_WORDS.items())
    js = lambda a, b: (
        f"sqrt(greatest(0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: {_part(a, b)} + {_part(b, a)})) / 2))"
    )
    shares = lambda values: "[" + ", ".join(f"{x / sum(values)!r}::DOUBLE" for x in values) + "]"
    references = ", ".join(f"('{lang}', {shares(kinds)}, {shares(common)})" for lang, (kinds, common) in q.REFERENCES.items())
    return f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lowered AS (SELECT *, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lw FROM d),
counted AS (SELECT *, CASE lang {cases} END AS named FROM lowered),
m AS (SELECT rid, doc_id, lang, t, w, length(t) AS n_chars, len(w) AS n_words, [{', '.join(named)}, {other}, {beyond}] AS kinds, list_append(named, (len(w) - list_sum(named))::BIGINT) AS common,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM counted),
ref(lang, all_kinds, all_common) AS (VALUES {references}),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM m))),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY 1),
joined AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, {js('kinds', 'all_kinds')} AS c_js, {js('common', 'all_common')} AS w_js
  FROM m LEFT JOIN ref ON m.lang = ref.lang LEFT JOIN repeated r USING (rid)),
base AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined)
SELECT doc_id, n_words::BIGINT AS n_words, list_sum(list_append(list_transform(w, lambda x: length(x)), 0))::BIGINT AS word_chars, kinds[{list(q.KINDS).index('symbol') + 1}]::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (n_chars < {q.LEAST_CHARS} OR coalesce(c_js, 0) <= {q.MOST_CHARACTERS}) AND (n_words < {q.LEAST_COMMON} OR coalesce(w_js, 0) <= {q.MOST_WORDS}) AS kept
FROM base"""


def _part(a: str, b: str) -> str:
    share = lambda x: f"({x}[i] / list_sum({x}))"
    return f"(CASE WHEN {a}[i] > 0 THEN {share(a)} * log2({share(a)} / (({share(a)} + {share(b)}) / 2)) ELSE 0 END)"


ORACLE_SQL = {"op1_divergence": divergence()}
