"""Cases in which operators once did less than the whole job."""

from pathlib import Path

import numpy as np
import pytest

from conftest import SMALL
from foliospark.operators import cells, retrieval as R
from foliospark.plans import register
from foliospark.plans.catalog import ORACLE_SQL, QUERIES
from foliospark.sources import scratch


# ------------------------------------------------------------- r9


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_cell_search_recall(spark, folder):
    assert QUERIES["r9_recall"](spark, folder).first()["recall"] >= 0.9


def test_cell_search_is_exact(spark):
    """Blobs far from each other (cells are skipped), a zero vector, equal ones and ones that are missing."""
    r = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[i % 8] * 9 + r.normal(size=8)).tolist()) for i in range(240)]
    rows += [(300, [0.0] * 8), (301, rows[5][1]), (302, rows[5][1]), (303, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.filter("id % 20 = 0 or id > 299").selectExpr("id as query_id", "embedding as query_vector")
    found = cells.cell_search(vectors, asked, cells.fit_cells(vectors.filter("id < 303"), k=8), probes=1, top=7).collect()
    some = vectors.filter("id < 303")
    exact = R.dense(some, asked.filter("query_id < 303"), 7).collect()
    key = lambda x: (x.query_id, x.id, x.distance, x.rank)
    assert sorted(map(key, found)) == sorted(map(key, exact))


# ------------------------------------------------------------- hybrid


def test_hybrid_finds_texts_without_vectors(spark):
    chunks = spark.createDataFrame([(1, "red fish", [1.0, 0.0]), (2, "blue bird", None), (3, "old stone", [0.0, 1.0])], "id long, text string, embedding array<float>")
    queries = spark.createDataFrame([(7, "blue bird", [1.0, 0.0]), (8, "old", None)], "query_id long, query_text string, query_vector array<float>")
    got = {(r.query_id, r.id): (r.dense_rank, r.sparse_rank) for r in R.hybrid(chunks, queries).collect()}
    assert got == {(7, 1): (1, None), (7, 3): (2, None), (7, 2): (None, 1), (8, 3): (None, 1)}


def test_hybrid_covers_documents_beyond_the_vectors(spark):
    """sf0.01 has 1,000 documents and 500 vectors."""
    import duckdb

    folder = SMALL.replace("0.001", "0.01")
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    columns = ["query_id", "id", "dense_rank", "sparse_rank", "rank"]
    got = list(tuple(None if x is None else int(x) for x in r) for r in QUERIES["r11_weighted_rrf"](spark, folder).select(*columns).collect())
    assert any(r[1] >= 500 for r in got)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL['r11_weighted_rrf']})").fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)


# ------------------------------------------------------------- many queries


def test_many_vector_queries_give_the_same_hits(spark, monkeypatch):
    """Beyond MAX_QUERIES the search goes by cells; the hits, tied ones too, are those of all pairs."""
    r = np.random.default_rng(5)
    rows = [(i, (np.eye(6)[i % 6] * 4 + r.normal(size=6)).round(1).tolist()) for i in range(200)]
    rows += [(300, [0.0] * 6), (301, rows[5][1]), (302, rows[5][1]), (303, None)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = chunks.selectExpr("id as query_id", "embedding as query_vector")
    key = lambda x: (x.query_id, x.id, x.distance, x.rank)
    exact = sorted(map(key, R.dense(chunks, asked, 4).collect()))
    monkeypatch.setattr(R, "MAX_QUERIES", 10)
    found = R.dense(chunks, asked, 4)
    assert sorted(map(key, found.collect())) == exact
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert R.dense(chunks.filter("false"), asked, 4).count() == 0


# ------------------------------------------------------- full-text predicates


def made_since(spark, act):
    """The names of the folders that are made below the application's scratch folder meanwhile, and what ``act`` gives."""
    top = Path(scratch.folder(spark, "x").removeprefix("file:")).parent
    names = lambda: {p.name for p in top.iterdir()} if top.is_dir() else set()
    before, out = names(), act()
    return names() - before, out


def alone(spark, monkeypatch, name, folder=SMALL):
    """A query's rows where no index is stored; it once wrote one, of every text's postings, for one predicate."""
    monkeypatch.setattr(register, "_indexes", {})
    made, df = made_since(spark, lambda: QUERIES[name](spark, folder))
    assert not [x for x in made if x.startswith("index")]
    rows = sorted(df.collect())
    monkeypatch.undo()
    return df, rows


def test_semi_join_asks_without_an_index(spark, monkeypatch):
    _, rows = alone(spark, monkeypatch, "j4_full_text_semi")
    register.Tables(spark, SMALL).index("papers", "id", ["title", "authors", "abstract"])
    assert rows and rows == sorted(QUERIES["j4_full_text_semi"](spark, SMALL).collect())


def test_full_text_asks_without_an_index(spark, monkeypatch):
    df, rows = alone(spark, monkeypatch, "f4_full_text")
    register.Tables(spark, SMALL).index("papers", "id", ["title", "authors", "abstract"])
    assert rows and df.columns == ["id"] and rows == sorted(QUERIES["f4_full_text"](spark, SMALL).collect())


@pytest.mark.parametrize("name", ["f4_phrase", "f4_negated_phrase"])
def test_phrases_ask_without_an_index(spark, monkeypatch, name):
    df, rows = alone(spark, monkeypatch, name)
    register.Tables(spark, SMALL).index("papers", "id", ["title", "authors", "abstract"])
    assert rows and df.columns == ["id"] and rows == sorted(QUERIES[name](spark, SMALL).collect())


@pytest.mark.parametrize("name", ["r12_normalised_scores", "r5_bm25_scores"])
def test_scores_are_made_where_the_documents_are(spark, monkeypatch, name):
    """Scores of all documents were sums over joined postings, a row for each posting and query that passed a shuffle."""
    df, rows = alone(spark, monkeypatch, name)
    assert len(rows) > 6_000 and "hashpartitioning" not in df._jdf.queryExecution().toString()
