"""Every query that has an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quantloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def text(v):
    return "null" if v is None or pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, oracle, name):
    got, want = plans.queries()[name](spark, FOLDER).toPandas(), oracle.sql(plans.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(tuple(text(v) for v in r) for r in df[columns].itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_seeded_query_repeats_itself(spark, name):
    """Queries without an oracle are seeded: they give rows, and the same ones again."""
    once, again = ([tuple(map(text, r)) for r in plans.queries()[name](spark, FOLDER).collect()] for _ in range(2))
    assert once and sorted(once) == sorted(again)
