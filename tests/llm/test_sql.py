import duckdb
import pytest

from prosegauge.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = con.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
