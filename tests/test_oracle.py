"""Every query of the catalogue against its SQL on the smallest tables, as the driver compares them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairn.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (float, np.floating)):
        return f"{value:.6f}"
    if isinstance(value, (list, np.ndarray)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows(df: pd.DataFrame, columns: list[str]) -> list:
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    mine, other = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    columns = sorted(mine.columns)
    assert rows(mine.astype(object), columns) == rows(other.astype(object), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
