"""Scores by role against SQL where deviations meet a threshold exactly."""

import statistics

import duckdb
from pyspark.sql import functions as F

from prosegauge.functions import segments as seg
from prosegauge.plans.catalog import ORACLE_SQL, QUERIES

#: Sentences of so many words deviate by exactly 4, the threshold; what SQL's stddev_samp makes of the first five is below it.
LENGTHS = [[5, 3, 3, 2, 14, 8, 6, 8, 11], [13, 5, 4, 14, 10, 3, 3, 9, 5, 5, 9, 3, 3, 12, 3, 3], [3, 3, 3, 3, 15, 3, 3, 3, 3], [13, 5, 2, 9, 14, 7, 6, 8], [8, 15, 3, 8, 2, 5, 6, 8, 11], [8, 8, 14, 2, 8, 8, 14, 2, 8, 8]]


def test_deviation_is_that_of_sql(spark):
    lists = [*LENGTHS, [7, 1], [5, 5, 5], [4], []]
    df = spark.createDataFrame([(i, [float(n) for n in x]) for i, x in enumerate(lists)], "i long, x array<double>")
    got = {r["i"]: (r["s"], r["p"]) for r in df.select("i", seg.sample_std(F.col("x")).alias("s"), seg.sample_std(F.col("x"), 1).alias("p")).collect()}
    for i, x in enumerate(lists):
        want = duckdb.execute("SELECT stddev_samp(n) FROM (SELECT unnest(?::BIGINT[]) AS n)", [x]).fetchone()[0]
        assert got[i][0] == want
        assert (got[i][1] is None) if not x else abs(got[i][1] - (statistics.stdev(x) if len(x) > 1 else 0)) < 1e-12


def test_scores_at_the_threshold(spark, tmp_path):
    rows = []
    for i, lengths in enumerate(LENGTHS):
        text = " ".join("A" + " blue" * (n - 1) + "." for n in lengths)
        rows += [(11 * i, 0, ("user", "assistant")[i % 2], text), (11 * i, 11, "system", text)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in QUERIES["score_by_role"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == set(con.execute(ORACLE_SQL["score_by_role"]).fetchall())
