import duckdb
import pytest

import __spark_entry__
from prosegauge.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"label", "n", "total"} == set(rows[0].asDict())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(df.columns)
    same = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted([same(v) for v in r] for r in df.select(*columns).collect()) == sorted([same(r[i]) for i in at] for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() == 200
