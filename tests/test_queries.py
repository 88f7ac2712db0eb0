"""Every registered query of the library against its SQL in DuckDB, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from foliospark.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


def rows(frame):
    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got.columns)
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert FLAGSHIP in entry.queries() and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
