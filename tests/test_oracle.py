"""Every query with an oracle gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine, other = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    assert rows(mine[columns]) == rows(other[columns])


def rows(df):
    """Rows as text, numbers as doubles and every kind of missing value as None, in order."""
    plain = lambda x: None if x is None or pd.isna(x) else float(x) if isinstance(x, (bool, int, float)) or hasattr(x, "dtype") else x
    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False))
