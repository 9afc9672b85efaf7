"""Every grid query with SQL against DuckDB on the smallest data; the others must run."""

import duckdb
import pandas as pd
import pytest

from gridweave.plans import catalogue
from gridweave.plans.roles import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if not hasattr(v, "__len__") and pd.isna(v):
        return "none"
    if isinstance(v, pd.Timestamp):
        return str(v.date()) if v == v.normalize() else str(v)
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.8g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        assert rows(found) == rows(duck.execute(sql).df())
