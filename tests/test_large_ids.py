"""Documents whose numbers have more than five digits: ids stay one paper's alone, and queries agree with their SQL."""

import hashlib

import duckdb
import pandas as pd
import pytest

from foliospark.plans.catalog import ORACLE_SQL, QUERIES
from foliospark.plans.views import VIEWS
from test_queries import rows

#: 10000 and 100000 have the same first five digits, and some of them the same month.
IDS = [5, *range(10_000, 10_012), 99_999, *range(100_000, 100_120), 1_000_003, 1_000_030]


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    folder = tmp_path_factory.mktemp("large")
    text = [f"Title of {i}. Method\nsome words on {i % 7} fish\n1. Heading\nmore on {i}" for i in IDS]
    docs = pd.DataFrame({"doc_id": IDS, "text": text, "lang": "en", "source": [f"src{i % 3}" for i in IDS], "n_chars": [len(x) for x in text]})
    docs.to_parquet(folder / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["e5_papers", "j5_skipped_rows", "m1_upsert", "t10_citation_edges", "u_comparison_inputs", "u_summary_inputs", "m7_id_union", "u_chunks_of"])
def test_agrees_with_sql(spark, large, name):
    folder, con = large
    got, want = rows(QUERIES[name](spark, folder).toPandas()), rows(con.sql(ORACLE_SQL[name]).df())
    assert got == want and len(got[1])


def test_ids_are_unique(spark, large):
    _, con = large
    assert con.sql(f"select count(distinct arxiv_id) from ({VIEWS['papers']})").fetchall() == [(len(IDS),)]


def test_chunk_text_is_whole(spark, tmp_path):
    """The beginnings of 30 chunks come to more than 8,000 characters; all of them count."""
    text = "".join(f"{i:07d} " for i in range(4_000))
    pd.DataFrame({"doc_id": [1], "text": [text], "lang": "en", "source": "s", "n_chars": [len(text)]}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    whole = "\n\n".join(text[800 * k : 800 * k + 500] for k in range(30))
    want = [(1, hashlib.md5(whole.encode()).hexdigest())]
    assert [tuple(r) for r in QUERIES["t23_chunk_text"](spark, str(tmp_path)).collect()] == want == con.sql(ORACLE_SQL["t23_chunk_text"]).fetchall()
