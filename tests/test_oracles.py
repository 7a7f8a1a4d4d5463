"""Every query that has SQL gives the same rows in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import ALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for r in ALL for n, q in r.queries.items()}
ORACLES = {n: s for r in ALL for n, s in r.oracles.items()}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
