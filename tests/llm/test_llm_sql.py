"""The queries that SQL expresses, against DuckDB on whole tables."""

import os

import duckdb
import pandas as pd
import pytest

from conftest import SMALL
from foliospark.llm.registry import ORACLE_SQL, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def same(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name, folder):
    same(spark, name, folder)


@pytest.mark.parametrize("name", ["op4_near_duplicates", "op6_decontamination"])
def test_sql_on_odd_texts(spark, name, tmp_path):
    """Null, empty and short texts, copies, a near copy, a row without id, and items shorter than a window."""
    passage = " ".join(f"Word{i}" for i in range(40))
    texts = [None, "", " \t\n", "one", "one", "Alpha beta", passage, passage.upper(), passage + " more", "x " * 200, "y alpha, BETA y", passage + "\n" + passage]
    docs = pd.DataFrame({"doc_id": pd.array([*range(len(texts)), None], "Int64"), "text": [*texts, passage]})
    items = pd.DataFrame({"item_id": [3, 20, 20, 5, 6], "text": ["alpha beta", passage[50:200], passage[50:200], None, "  "]})
    docs.to_parquet(tmp_path / "documents.parquet")
    items.to_parquet(tmp_path / "benchmark.parquet")
    same(spark, name, str(tmp_path))
