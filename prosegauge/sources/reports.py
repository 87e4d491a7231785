"""Reports as columns: console text, Markdown, and a page of HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg
from prosegauge.functions.ship import ship


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _hits(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " hit").otherwise(" hits"))


def console(title: str = "Style score") -> Column:
    """The console report of a scored row."""
    parts = [_text(f"\n{title}: ", F.col("score"), "/100 [", F.col("label"), "]\n")]
    for key in lex.DISPLAY_ORDER:
        n = F.size(F.col(key)["hits"])
        parts.append(F.when(n == 0, f"=== {lex.SECTIONS[key]} — clean ===\n").otherwise(_text(f"=== {lex.SECTIONS[key]} (", _hits(n), ") ===\n", F.array_join(F.col(key)["hits"], "\n"), "\n")))
    summary = F.concat_ws(" | ", *[_text(f"{lex.SUMMARY_NAMES[k]}: ", F.size(F.col(k)["hits"])) for k in lex.DISPLAY_ORDER])
    return F.concat_ws("\n", *parts, _text("=== Summary: ", summary, " ==="))


def statistics(text: Column) -> dict[str, Column]:
    """Figures of the text as it is given, not normalised: words, sentences, paragraphs, word length, spread of sentence lengths, variety."""
    words, sents = seg.words(text), seg.sentences(text)
    alpha = F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    unique = F.size(F.array_distinct(F.transform(alpha, F.lower)))
    return {
        "words": F.size(words),
        "sentences": F.size(sents),
        "paragraphs": F.size(seg.paragraphs(text)),
        "word_length": F.coalesce(seg.mean(F.transform(alpha, lambda w: F.length(w).cast("double"))), F.lit(0.0)),
        "sentence_std": F.coalesce(seg.sample_std(F.transform(sents, lambda s: seg.n_words(s).cast("double"))), F.lit(0.0)),
        "variety": F.coalesce(F.try_divide(unique, F.size(alpha)), F.lit(0.0)),
        "unique_words": unique,
    }


def markdown(scored: DataFrame, name: Column, text: str = "text", footer: str | None = None, title: str = "Style Report") -> DataFrame:
    """``scored`` with a column ``report``. The footer, as a time stamp, is left to the caller."""
    own = scored.select("*", F.struct(*[c.alias(k) for k, c in statistics(F.col(text)).items()]).alias("stats"))
    score = F.col("score")
    full = F.floor(score / 5).cast("int")
    head = [_text(f"# {title}: ", name), F.lit(""), _text("**Score: ", score, "/100 [", F.col("label"), "]**"), F.lit(""), _text("`[", F.repeat(F.lit("#"), full), F.repeat(F.lit("."), 20 - full), "]` ", score, "/100"), F.lit("")]
    table = [F.lit("## Score Breakdown\n\n| Category | Hits | Raw Score | Weight | Weighted |\n|----------|------|-----------|--------|----------|")]
    for k in lex.DISPLAY_ORDER:
        raw, weight = F.col(k)["raw"], lex.WEIGHTS[k]
        table.append(_text(f"| {lex.SECTIONS[k]} | ", F.size(F.col(k)["hits"]), " | ", seg.fixed(raw, 2), f" | {weight:.0%} | ", seg.fixed(raw * weight, 2), " |"))
    s = F.col("stats")
    figures = _text("\n## Text Statistics\n\n| Metric | Value |\n|--------|-------|\n| Words | ", s["words"], " |\n| Sentences | ", s["sentences"], " |\n| Paragraphs | ", s["paragraphs"], " |\n| Avg word length | ", seg.fixed(s["word_length"], 1), " chars |\n| Burstiness (sentence length std dev) | ", seg.fixed(s["sentence_std"], 1), " |\n| Lexical diversity (type-token ratio) | ", seg.fixed(s["variety"], 2), " |\n| Unique words | ", s["unique_words"], " |\n")
    issues = F.flatten(F.array(*[F.transform(F.col(k)["hits"], _issue(k)) for k in lex.DISPLAY_ORDER]))
    top = F.when(F.size(issues) > 0, _text("## Top Issues\n\n", F.array_join(issues, "\n"), "\n"))
    found = [F.lit("## Detailed Findings\n")]
    for k in lex.DISPLAY_ORDER:
        hits = F.col(k)["hits"]
        found.append(_text(f"### {lex.SECTIONS[k]} (", _hits(F.size(hits)), ")\n\n", F.when(F.size(hits) == 0, "No issues found.").otherwise(F.array_join(F.transform(hits, lambda h: F.concat(F.lit("- `"), seg.strip(h), F.lit("`"))), "\n")), "\n"))
    end = [F.lit("---")] + ([F.lit(f"*{footer}*")] if footer else [])
    return own.withColumn("report", F.concat_ws("\n", *head, *table, figures, top, *found, *end)).drop("stats")


def _issue(key: str):
    return lambda h: F.concat(F.lit(f"- **{lex.SECTIONS[key]}**: "), seg.strip(h))


def long_hits(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each hit: key, check, place in the check, text."""
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k)["hits"].alias("hits")) for k in lex.DISPLAY_ORDER])
    return scored.select(key, F.explode(each).alias("x")).select(key, F.col("x.check").alias("check"), F.posexplode("x.hits").alias("place", "hit"))


# Emphasis, strongest first.
_INLINE = [(re.compile(r"\*\*\*(.+?)\*\*\*"), r"<strong><em>\1</em></strong>"), (re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"\*(.+?)\*"), r"<em>\1</em>"), (re.compile(r"_(.+?)_"), r"<em>\1</em>")]
_CODE = re.compile(r"`([^`]+)`")
_RULE = re.compile(r"\|[\s\-:|]+\|")
LABELS = ("CLEAN", "MILD", "NOTICEABLE", "OBVIOUS", "BLATANT")
_HOLE = "\ue000"  # stands for a piece of code while emphasis is looked for
STYLE = "body{font-family:sans-serif;max-width:52em;margin:2em auto;padding:0 1em;line-height:1.5}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em}code{background:#f4f4f4}.score-clean{color:green}.score-mild{color:olive}.score-noticeable{color:orange}.score-obvious{color:red}.score-blatant{color:darkred}"


def escape(text: str) -> str:
    return html.escape(text, quote=False).replace('"', "&quot;")


def inline(text: str) -> str:
    """Escaped text with code, bold and emphasis; what stands in code is left alone, emphasis may reach over it."""
    pieces = _CODE.split(escape(text))
    flat = _HOLE.join(pieces[::2])
    for pattern, by in _INLINE:
        flat = pattern.sub(by, flat)
    code = iter(pieces[1::2])
    return re.sub(_HOLE, lambda m: f"<code>{c}</code>" if (c := next(code, None)) is not None else m[0], flat)


def _cells(line: str, tag: str) -> list[str]:
    return [f"<{tag}>{inline(c.strip())}</{tag}>" for c in line.split("|")[1:-1]]


def markdown_to_html(text: str) -> str:
    """The Markdown of reports: headings, rules, tables, lists, quotes, paragraphs.

    One block is open at a time, or a table and nothing else across empty lines.
    """
    out: list[str] = []
    open_: str | None = None
    ends = {"ul": "</ul>", "ol": "</ol>", "p": "</p>", "table": "</tbody></table>"}

    def enter(block: str | None, *begin: str) -> bool:
        """Whether another block had to be closed, or none was open, before this one."""
        nonlocal open_
        if open_ == block:
            return False
        if open_ is not None:
            out.append(ends[open_])
        out.extend(begin)
        open_ = block
        return True

    lines = [x.strip() for x in text.split("\n")]
    skipped = -1
    for i, line in enumerate(lines):
        if i == skipped:
            continue
        if not line:
            if open_ != "table":
                enter(None)
        elif re.fullmatch(r"-{3,}", line):
            enter(None)
            out.append("<hr>")
        elif m := re.match(r"(#{1,6})\s+(.+)", line):
            enter(None)
            level, said = len(m[1]), inline(m[2])
            named = [x for x in LABELS if f"[{x}]" in said]
            kind = f' class="score-{named[-1].lower()}"' if level == 2 and named else ""
            out.append(f"<h{level}{kind}>{said}</h{level}>")
        elif line.startswith("|"):
            if enter("table", "<table><thead><tr>"):
                out += [*_cells(line, "th"), "</tr></thead><tbody>"]
                if i + 1 < len(lines) and _RULE.fullmatch(lines[i + 1]):
                    skipped = i + 1
            else:
                out += ["<tr>", *_cells(line, "td"), "</tr>"]
        elif m := re.match(r"[-*]\s+(.+)", line):
            enter("ul", "<ul>")
            out.append(f"<li>{inline(m[1])}</li>")
        elif m := re.match(r"\d+\.\s+(.+)", line):
            enter("ol", "<ol>")
            out.append(f"<li>{inline(m[1])}</li>")
        elif line.startswith(">"):
            enter(None)
            out.append(f"<blockquote><p>{inline(line.lstrip('> '))}</p></blockquote>")
        else:
            out.append(("" if enter("p", "<p>") else "<br>") + inline(line))
    enter(None)
    return "\n".join(out)


def html_page(body: str, title: str = "Style Report") -> str:
    return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{escape(title)}</title>\n<style>{STYLE}</style>\n</head>\n<body>\n{body}\n</body>\n</html>\n'


def to_html(df: DataFrame, column: str = "report", title: str = "Style Report") -> DataFrame:
    """``df`` with each Markdown report turned into a page in ``page``: a line parser with state, so Python over batches."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != column]

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[kept].assign(page=b[column].map(lambda t: html_page(markdown_to_html(t or ""), title)))

    return df.mapInPandas(pages, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != column], "page string"]))
