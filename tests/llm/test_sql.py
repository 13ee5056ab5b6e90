"""The queries that SQL can express against their SQL on the smallest tables."""

import duckdb
import pytest

from cairn.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    mine = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(f"select {', '.join(mine.columns)} from ({queries.SQL[name]})").fetchall()
    key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    assert sorted((tuple(r) for r in mine.collect()), key=key) == sorted(want, key=key)
