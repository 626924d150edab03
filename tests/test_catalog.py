"""Every query with SQL gives the SQL's rows."""

import duckdb
import pandas as pd
import pytest

from archivolt.plans import annotation, catalog, effects, learning, networks, shaping, tidying  # noqa: F401 - these register their queries
from archivolt.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(v):
        if pd.isna(v):
            return "null"
        return str(v) if isinstance(v, (str, bool)) else repr(float(v)) if hasattr(v, "__float__") else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE[name]).df())
