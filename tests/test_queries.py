"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import duckdb
import pandas as pd
import pytest

from cellweave.plans.catalog import QUERIES
from cellweave.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    got = query(spark, SF).toPandas()
    if sql is None:
        assert len(got)
    else:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
