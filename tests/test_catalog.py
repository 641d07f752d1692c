"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ballotry import catalog

DIR = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "documents", "events", "embeddings", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        return f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DIR).toPandas()
    if name in catalog.oracle_sql():
        want = duck.execute(catalog.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)
