"""Named queries over the test tables, with their DuckDB equivalents.

Each takes (spark, sf_dir) and reads whole tables. Texts carry the planted
sentences of ``planted``. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lex
from prosegauge.functions import segments as seg
from prosegauge.operators import burstiness, compression, formatting, phrases, structure, tone, vocabulary
from prosegauge.plans import oracle, oracle_reports, scoring
from prosegauge.plans.planted import literal, planted
from prosegauge.sources import reports

#: Compatibility forms, letters of other scripts with marks, and what normalisation makes of them, by hand.
FORMS = " \u0451\u0419 \ufb01 \u2163 \u2460 \u00bd \u2126 \uac00 \u0390 \u3099 \u0e33"
PLAIN_FORMS = " \u0435\u0418 fi IV 1 1\u20442 \u03a9 \uac00 \u03b9  \u0e32"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str, key: str = "doc_id") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumn("text", planted(key=key)) if "text" in df.columns else df


def spread(df: DataFrame) -> DataFrame:
    """Small inputs come in few splits; scoring is heavy for each row, so few rows go round once to use all cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segment(documents(spark, sf_dir).select("doc_id", "text"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prepared(documents(spark, sf_dir).select("doc_id", "text"))


def query(name: str, columns: dict[str, Column | Callable[[], Column]], sql: str, source: Callable = _prepared) -> None:
    """A query of one row for each document: columns by name, and what SQL selects beside doc_id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {k: (v() if callable(v) else v) for k, v in columns.items()}
        return source(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in made.items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle.prelude() + f"SELECT doc_id, {sql} FROM checks"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def digest(items) -> Column:
    return F.md5(F.array_join(items, "|"))


def _define() -> None:
    query("word_counts", {"n_words": lambda: big("nw")}, "nw AS n_words", _segmented)
    query("sentence_split", {"n": lambda: big(F.size("sents")), "digest": lambda: digest("sents")}, "ns AS n, md5(array_to_string(sents, '|')) AS digest", _segmented)
    query("paragraph_split", {"n": lambda: big(F.size("paras")), "digest": lambda: digest("paras")}, "len(paras) AS n, md5(array_to_string(paras, '|')) AS digest", _segmented)
    query("line_split", {"n": lambda: big(F.size("lines")), "digest": lambda: digest("lines")}, "len(lines) AS n, md5(array_to_string(lines, '|')) AS digest", _segmented)
    query("alpha_tokens", {"n": lambda: big(F.size("tokens")), "digest": lambda: digest("tokens")}, "len(tokens) AS n, md5(array_to_string(tokens, '|')) AS digest", _segmented)
    query("edge_stripped_words", {"digest": lambda: digest("bare"), "n_alpha": lambda: big("tone_alpha")}, "md5(array_to_string(bare, '|')) AS digest, n_alpha")
    query("normalize_latin", {"digest": lambda: F.md5("t"), "native": lambda: F.md5(seg.normalize_native(F.col("text")))}, "md5(t) AS digest, md5(t) AS native", _segmented)
    plain = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))
    wide = lambda: F.translate("text", plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    query("normalize_forms", {"digest": lambda: F.md5(seg.normalize(F.concat(wide(), F.lit(FORMS))))}, f"md5(t || {literal(PLAIN_FORMS)}) AS digest", _segmented)
    query("word_overlap", {"overlap": lambda: six(seg.overlap(F.try_element_at("lines", F.lit(1)), F.try_element_at("lines", F.lit(-1))))}, f"round({oracle.overlap('lines[1]', 'lines[-1]')}, 6) AS overlap", _segmented)
    query(
        "find_line",
        {"line": lambda: seg.find_line(F.col("low_lines"), F.get("words", F.floor(F.col("nw") / 2).cast("int"))), "absent": lambda: seg.find_line(F.col("low_lines"), F.lit("no such snippet"))},
        "coalesce(nullif(list_position(list_transform(lines, lambda l_: contains(lower(l_), lower(words[nw // 2 + 1]))), true), 0)::VARCHAR, '?') AS line, '?' AS absent",
        _segmented,
    )
    query("vocab_exact", {"n_single": lambda: big(vocabulary.single_count())}, "vocab_single::BIGINT AS n_single")
    query("vocab_multi", {"n_several": lambda: big(vocabulary.several_count()), "raw": lambda: six(vocabulary.raw())}, "vocab_several::BIGINT AS n_several, round(r_vocabulary, 6) AS raw")
    query("starter_hits", {"n": lambda: big(phrases.starter_count()), "raw": lambda: six(phrases.raw())}, "starters::BIGINT AS n, round(r_phrases, 6) AS raw")
    query("struct_length_std", {"std": lambda: six("st_std")}, "round(sent_std, 6) AS std")
    query("struct_streaks", {"n": lambda: big(F.size("st_streaks")), "sentences": lambda: big(F.aggregate("st_streaks", F.lit(0), lambda s, x: s + x["n"]))}, "streaks::BIGINT AS n, streak_sentences::BIGINT AS sentences")
    query("struct_patterns", {k: (lambda k=k: big(F.size(f"st_{k}"))) for k in ("participial", "negative", "answer", "sides", "analogy", "disclaimer")}, "participial, negative, answer, sides, analogy, disclaimer")
    query("para_uniformity", {"mean": lambda: six(seg.mean(F.col("st_counts"))), "std": lambda: six(seg.sample_std(F.col("st_counts"), 1))}, "round(p_mean, 6) AS mean, round(p_std, 6) AS std")
    query("fractal_overlap", {"n": lambda: big(F.size("st_fractal"))}, "fractal::BIGINT AS n")
    query("conclusion_overlap", {"overlap": lambda: six("st_conclusion")}, "round(conclusion, 6) AS overlap")
    query("struct_anaphora", {"n": lambda: big(F.size("st_anaphora"))}, "anaphora::BIGINT AS n")
    query("struct_tricolon", {"n": lambda: big(F.size("st_tricolon")), "flag": structure.tricolon_flag}, "tricolon AS n, tricolon >= greatest(3, ns // 8) AS flag")
    query("essay_formula", {"essay": lambda: F.col("st_essay")}, "coalesce(essay, false) AS essay")
    query("structure_score", {"flags": lambda: big(structure.flags()), "raw": lambda: six(structure.raw())}, "flags::BIGINT AS flags, round(r_structure, 6) AS raw")
    query(
        "format_counts",
        {"dashes": lambda: big(formatting.count(formatting.DASH)), "bullets": lambda: big(formatting.count(formatting.BOLD_BULLET)), "headers": lambda: big(formatting.count(formatting.HEADER)), "titles": lambda: big(formatting.count(formatting.TITLE_CASE)), "raw": lambda: six(formatting.raw())},
        "em::BIGINT AS dashes, bullets, headers, titles, round(r_formatting, 6) AS raw",
    )
    names = {"hedges": "hedges", "exclamations": "exclamations", "enthusiasm": "enthusiasm", "contractions": "contractions", "abstract": "abstract", "intensifiers": "intensifiers", "conversational": "conversational", "conjunctions": "conjunctions"}
    query(
        "tone_signals",
        {k: (lambda v=v: big(f"tone_{v}")) for k, v in names.items()} | {"formality": lambda: six("tone_formality_std"), "word_length": lambda: six("tone_word_length"), "long_ratio": lambda: six("tone_long_ratio")},
        ", ".join(f"({v})::BIGINT AS {k}" for k, v in names.items()) + ", CASE WHEN ns >= 5 THEN round(f_std, 6) END AS formality, round(word_length, 6) AS word_length, round(long_ratio, 6) AS long_ratio",
    )
    query("tone_composite", {"raw": lambda: six(tone.raw())}, "round(r_tone, 6) AS raw")
    query("rhythm_cv", {"cv": lambda: six("rh_cv")}, "round(cv, 6) AS cv")
    query("punct_entropy", {"n": lambda: big("pu_total"), "entropy": lambda: six("pu_entropy")}, "n_marks::BIGINT AS n, round(entropy, 6) AS entropy")
    query("connective_density", {"density": lambda: six("co_density"), "examples": lambda: F.array_join(F.array_sort(F.array_distinct("co_found")), ",")}, "round(density, 6) AS density, array_to_string(list_sort(list_distinct(connectives)), ',') AS examples")
    query("burstiness_fold", {"burstiness": lambda: six("bu_mean")}, "round(burstiness, 6) AS burstiness")


def _counted(name: str, sql: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle.prelude() + sql
        return f

    return put


def _forms(spark: SparkSession) -> DataFrame:
    """The fixed list of 3,604 forms, small enough for any executor."""
    return F.broadcast(spark.createDataFrame(list(vocabulary._FORMS.items()), "c string, lemma string"))


@_counted("vocab_stem", "SELECT lemma, count(*) AS n FROM vocab_hits GROUP BY 1")
def vocab_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each listed word occurs, inflected or not."""
    # an inner generator would make Spark test the words for emptiness below the exchange, and normalise every text twice
    words = _segmented(spark, sf_dir).select(F.explode_outer("words").alias("w")).select(seg.cleaned(F.col("w")).alias("c"))
    return words.join(_forms(spark), "c").groupBy("lemma").agg(F.count("*").alias("n"))


@_counted("kwic", "SELECT doc_id, pos::BIGINT AS pos, lemma, c5 AS context FROM (SELECT k_, pos, string_agg(w, ' ' ORDER BY pos) OVER (PARTITION BY k_ ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c5 FROM word_rows) JOIN vocab_hits USING (k_, pos) JOIN seg USING (k_)")
def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed words with five words on either side, over the whole text."""
    rows = _segmented(spark, sf_dir).select("doc_id", "words", vocabulary.listed(F.col("words")).alias("hits"))
    first = lambda x: F.greatest(x["j"] - 5, F.lit(1))
    near = lambda x: F.array_join(F.slice("words", first(x), F.least(x["j"] + 5, F.size("words")) - first(x) + 1), " ")
    return rows.select("doc_id", F.inline(F.transform("hits", lambda x: F.struct(big(x["j"]).alias("pos"), x["lemma"].alias("lemma"), near(x).alias("context")))))


@_counted("phrase_hits", "SELECT doc_id, category, sum(n)::BIGINT AS n FROM phrase_rows JOIN seg USING (k_) GROUP BY 1, 2")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock phrases by document and category: the fixed list of 71 meets each text inside its row."""
    terms = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("category")) for c, ps in lex.PHRASES.items() for p in ps])
    rows = _segmented(spark, sf_dir).select("doc_id", "low", F.filter(terms, lambda x: F.contains(F.col("low"), x["p"])).alias("x"))
    each = rows.select("doc_id", "low", F.inline_outer("x")).where("p is not null")  # an inner generator's test would go below the exchange
    return each.groupBy("doc_id", "category").agg(F.sum(vocabulary.count_of(F.col("low"), F.col("p"))).alias("n"))


@_counted("burstiness_gaps", "SELECT doc_id, round(burstiness, 6) AS burstiness FROM checks WHERE burstiness IS NOT NULL")
def burstiness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window form of the burstiness check."""
    return burstiness.by_window(_segmented(spark, sf_dir).select("doc_id", "tokens")).select("doc_id", six("burstiness").alias("burstiness"))


@_counted("compression_similarity", "")
def compression_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a seed of all the benchmark's texts, which each worker reads once."""
    seed = compression.seed_corpus(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    docs = documents(spark, sf_dir).select("doc_id", seg.normalize(F.col("text")).alias("t"))
    return docs.select("doc_id", compression.similarity(F.col("t"), seed).alias("similarity")).select("doc_id", "similarity", compression.raw().alias("raw"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.raws(documents(spark, sf_dir)).select("doc_id", "lang", "source", "score", "label")


@_counted("score_no_compression", "SELECT doc_id, score, label FROM checks")
def score_no_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", "score", "label")


@_counted("label_histogram", "SELECT label, count(*) AS n, sum(score)::BIGINT AS total FROM checks GROUP BY 1")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@_counted("score_by_lang", "SELECT lang, source, count(*) AS n, sum(score)::BIGINT AS total FROM checks GROUP BY ROLLUP (lang, source)")
def score_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@_counted("class_separation", "SELECT round(avg(score) FILTER (quality = 0), 6) AS mean_0, round(avg(score) FILTER (quality = 1), 6) AS mean_1, round(avg(score) FILTER (quality = 1) - avg(score) FILTER (quality = 0), 6) AS separation FROM checks JOIN labels USING (doc_id)")
def class_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of the two classes of labelled documents and their difference: only labelled documents are scored."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = scoring.raws(spread(read(spark, sf_dir, "documents")).select("doc_id", "text").join(labels, "doc_id"))
    mean = lambda q: F.avg(F.when(F.col("quality") == q, F.col("score")))
    return scored.agg(six(mean(0)).alias("mean_0"), six(mean(1)).alias("mean_1"), six(mean(1) - mean(0)).alias("separation"))


def score_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(read(spark, sf_dir, "conversations", "conv_id * 100 + turn"))
    return scoring.raws(turns).groupBy("role").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


QUERIES["score_by_role"] = score_by_role
ORACLE_SQL["score_by_role"] = oracle.prelude("conversations", "(conv_id * 100 + turn)", "role") + "SELECT role, count(*) AS n, sum(score)::BIGINT AS total FROM checks GROUP BY 1"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir).select("doc_id", "text"))


@_counted("hits_long", "SELECT doc_id, (vocab_single + vocab_several)::BIGINT AS vocabulary, (phrase_count + starters)::BIGINT AS phrases FROM checks WHERE vocab_single + vocab_several + phrase_count + starters > 0")
def hits_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits counted from their long form."""
    rows = reports.long_hits(_evidence(spark, sf_dir)).where(F.col("check").isin("vocabulary", "phrases"))
    n = lambda c: F.count(F.when(F.col("check") == c, True))
    return rows.groupBy("doc_id").agg(n("vocabulary").alias("vocabulary"), n("phrases").alias("phrases"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    s = reports.statistics(F.col("text"))
    exact = ("words", "sentences", "paragraphs", "unique_words")
    return docs.select("doc_id", *[(big(c) if k in exact else six(c)).alias(k) for k, c in s.items()])


QUERIES["text_statistics"] = text_statistics
_ALPHA = f"list_filter({oracle.words('text')}, lambda w_: regexp_full_match(w_, '\\pL+'))"
ORACLE_SQL["text_statistics"] = (
    oracle.prelude()
    + f""", raw_sents AS (SELECT k_, {oracle.sentences('text')} AS rs, {_ALPHA} AS ra FROM base),
lengths AS (SELECT k_, stddev_samp(n) AS sd FROM (SELECT k_, len({oracle.words('s')}) AS n FROM (SELECT k_, unnest(rs) AS s FROM raw_sents)) GROUP BY 1)
SELECT doc_id, len({oracle.words('base.text')}) AS words, len(rs) AS sentences,
len(list_filter(regexp_split_to_array(base.text, '\\n\\s*\\n'), lambda q_: len({oracle.words('q_')}) >= 5)) AS paragraphs,
round(coalesce(list_avg(list_transform(ra, lambda a_: length(a_))), 0), 6) AS word_length, round(coalesce(sd, 0), 6) AS sentence_std,
round(coalesce(len(list_distinct(list_transform(ra, lambda a_: lower(a_))))::DOUBLE / nullif(len(ra), 0), 0), 6) AS variety, len(list_distinct(list_transform(ra, lambda a_: lower(a_)))) AS unique_words
FROM base JOIN raw_sents USING (k_) LEFT JOIN lengths USING (k_)"""
)


@_counted("hit_texts", "")
def hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of every check as the user reads it, with its place in the check."""
    return reports.long_hits(_evidence(spark, sf_dir)).select("doc_id", "check", big("place").alias("place"), "hit")


@_counted("report_console", "")
def report_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", reports.console().alias("report"))


@_counted("report_markdown", "")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown(_evidence(spark, sf_dir), F.concat(F.lit("document "), F.col("doc_id"))).select("doc_id", "report")


@_counted("report_html", "")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.to_html(report_markdown(spark, sf_dir))


_define()
ORACLE_SQL["hit_texts"] = oracle_reports.hit_texts()
ORACLE_SQL["report_console"] = oracle_reports.console()
ORACLE_SQL["report_markdown"] = oracle_reports.markdown(ORACLE_SQL["text_statistics"])
