import io

from pyspark.sql import functions as F

from prosegauge.functions.register import register
from prosegauge.plans import scoring
from prosegauge.sources import files, reports
from prosegauge.streaming.scoring import score_stream


def test_html():
    page = reports.markdown_to_html("# A <b>\n\n## Score [MILD]\n| x | y |\n|---|---|\n| 1 | `a*b*` |\n\n- one\n- **two**\n\n1. first\n\n> quote\n\nline _em_\nnext\n\n---")
    assert page.split("\n") == ["<h1>A &lt;b&gt;</h1>", '<h2 class="score-mild">Score [MILD]</h2>', "<table><thead><tr>", "<th>x</th>", "<th>y</th>", "</tr></thead><tbody>", "<tr>", "<td>1</td>", "<td><code>a*b*</code></td>", "</tr>", "</tbody></table>",
        "<ul>", "<li>one</li>", "<li><strong>two</strong></li>", "</ul>", "<ol>", "<li>first</li>", "</ol>", "<blockquote><p>quote</p></blockquote>", "<p>", "line <em>em</em>", "<br>next", "</p>", "<hr>"]
    assert "<title>a &amp; b</title>" in reports.html_page("", "a & b")


def test_html_corner_cases():
    lines = lambda md: reports.markdown_to_html(md).split("\n")
    assert lines("a_b_c **x `y_z_` w** \"q\"") == ["<p>", 'a<em>b</em>c <strong>x <code>y_z_</code> w</strong> &quot;q&quot;', "</p>"]
    assert lines("+ no bullet") == ["<p>", "+ no bullet", "</p>"]
    assert lines("| a | b |\n| c | d |\n\n| e | f |\ntext") == ["<table><thead><tr>", "<th>a</th>", "<th>b</th>", "</tr></thead><tbody>", "<tr>", "<td>c</td>", "<td>d</td>", "</tr>", "<tr>", "<td>e</td>", "<td>f</td>", "</tr>", "</tbody></table>", "<p>", "text", "</p>"]
    assert lines("- a\n1. b\n- c") == ["<ul>", "<li>a</li>", "</ul>", "<ol>", "<li>b</li>", "</ol>", "<ul>", "<li>c</li>", "</ul>"]
    assert lines("## x [CLEAN] [MILD]") == ['<h2 class="score-mild">x [CLEAN] [MILD]</h2>'] and lines("#### [MILD]") == ["<h4>[MILD]</h4>"]
    assert lines("> > deep\n---") == ["<blockquote><p>deep</p></blockquote>", "<hr>"] and lines("") == [""]


def test_markdown_and_long_hits(spark):
    df = spark.createDataFrame([(1, "We leverage synergy. In conclusion, we stop here now.")], "doc_id long, text string")
    scored = scoring.score(df)
    (r,) = reports.markdown(scored, F.lit("mine")).collect()
    assert r["report"].startswith("# Style Report: mine\n\n**Score: ") and "| Words | 9 |" in r["report"] and "### Banned Vocabulary (2 hits)" in r["report"]
    assert reports.long_hits(scored).where("check = 'phrases'").count() == 1
    assert "(1 hit)" in scored.select(reports.console()).first()[0]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("First line.\nSecond line.")
    df = files.read_texts(spark, str(tmp_path / "in"))
    assert tuple(df.select("text", "warning").first()) == ("First line.\nSecond line.", None)
    cut = files.read_texts(spark, str(tmp_path / "in"), 5).first()
    assert cut["text"] == "First" and cut["warning"] == "input truncated to 5 of 24 characters"
    typed = files.read_stream(spark, io.StringIO("typed text"), 5).first()
    assert tuple(typed) == ("-", "typed", "input truncated to 5 characters") and files.read_stream(spark, io.StringIO("typed")).first()["warning"] is None
    spark.createDataFrame([(1, "We leverage robust synergy here.")], "doc_id long, text string").write.parquet(str(tmp_path / "p"))
    stream = score_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "p")))
    q = stream.select("doc_id", "score", "label").writeStream.format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select label from scores").first()[0] == "CLEAN"
    register(spark)
    assert spark.sql("select style_normalize('a\u200bb')").first()[0] == "ab"
