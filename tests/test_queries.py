"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracelake import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    text = lambda x: "~" if pd.isna(x) else repr(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert plain(registry.queries()[name](spark, FOLDER).toPandas()) == plain(db.sql(SQL[name]).df())


def test_entry_runs_without_the_optional_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
