"""Every registered query that has SQL against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)

    def one(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "__float__") and not isinstance(x, (str, bool)) else str(x)

    return columns, sorted((tuple(one(x) for x in row) for row in df[columns].itertuples(index=False)), key=repr)


def names():
    from quernstone.plans.queries import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from quernstone.plans.queries import QUERIES, SQL

    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
