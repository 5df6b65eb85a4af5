"""Every query with SQL gives DuckDB's rows; every other one runs."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from voltaic.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine = catalog.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and p == pytest.approx(q, abs=2e-5)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0
