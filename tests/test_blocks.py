"""Searches by blocks give the hits of all pairs, of any block size, with ties, odd vectors and few shared buckets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import blocks, retrieval as R

KEY = lambda x: (x.query_id, x.id, x.distance, x.rank)


def table(spark, seed=7, n=150, d=5):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=d).round(1).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, [0.0] * d), (n + 3, None)], "id long, embedding array<float>")


def all_pairs(chunks, asked, top, distance):
    pairs = chunks.filter("embedding is not null").crossJoin(asked.filter("query_vector is not null"))
    return sorted(map(KEY, R.ranked(pairs.select("query_id", "id", F.round(distance, 6).alias("distance")), [F.asc("distance"), F.asc("id")], top).collect()))


@pytest.mark.parametrize("size", [(32_768, 4_096), (20, 9)])
def test_dense_equals_all_pairs(spark, monkeypatch, size):
    chunks = table(spark)
    asked = chunks.filter("id % 3 = 0").selectExpr("id as query_id", "embedding as query_vector")
    monkeypatch.setattr(blocks, "ROWS", size[0])
    monkeypatch.setattr(R, "MAX_QUERIES", size[1])
    found = R.dense(chunks, asked, 6)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # a plan that makes a row for each pair, as before
    assert sorted(map(KEY, found.collect())) == all_pairs(chunks, asked, 6, R.cosine_distance(F.col("embedding"), F.col("query_vector")))


def test_hashes_equal_a_join_on_buckets(spark):
    """Narrow buckets, so that many pairs share none; no shuffle of pairs or vectors by buckets."""
    chunks = table(spark)
    asked = chunks.filter("id % 3 = 0").selectExpr("id as query_id", "embedding as query_vector")
    found = R.dense_by_hashes(chunks, asked, 6, length=0.05, tables=2)
    assert "query_id" in found.columns and "entry" not in found._jdf.queryExecution().toString()
    unit = lambda v: {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in v.collect() if r[1] is not None and any(r[1])}
    x, q = unit(chunks), unit(asked)
    hits = {}
    for r in found.collect():
        assert abs(r.distance - ((x[r.id] - q[r.query_id]) ** 2).sum() / 2) < 1e-6
        hits.setdefault(r.query_id, []).append(r.id)
    assert set(hits) == set(q) and all(k in v or len(v) == 6 for k, v in hits.items())  # itself shares all buckets
    wide = R.dense_by_hashes(chunks, asked.filter("query_id < 150"), 6)
    exact = R.dense(chunks.filter("id <> 152"), asked.filter("query_id < 150"), 6)
    assert [(r[0], r[1], r[3]) for r in sorted(map(KEY, wide.collect()))] == [(r[0], r[1], r[3]) for r in sorted(map(KEY, exact.collect()))]


def test_few_shared_buckets():
    r = np.random.default_rng(1)
    c, h, g = r.random((9, 80)), r.integers(0, 12, (80, 2)), r.integers(0, 12, (9, 2))
    met = (h[None, :, :] == g[:, None, :]).any(2)
    k, i = blocks._sharing(c, 4, h, g)
    for q in range(9):
        own = np.flatnonzero(met[q])
        assert set(own[np.argsort(-c[q][own])][:4]) <= set(i[k == q]) <= set(own)


def test_rounded_as_spark(spark):
    values = [0.0, 0.0000005, 0.1234565, 1.0000005, 0.3333335, 2.5e-7, 1.9999995, 12.3456785, math.pi]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6)).collect()]
    assert blocks.rounded(np.array(values)).tolist() == want


@pytest.mark.parametrize("small", [False, True])
def test_best_scores_are_those_of_all(spark, monkeypatch, small):
    """Ties, equal documents, blank ones and a query without hits; no row for each document and query."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{min(int(x), 20)}" for x in r.exponential(6, r.integers(1, 30))) for _ in range(90)]
    docs = spark.createDataFrame([*enumerate(texts), (90, texts[4]), (91, texts[4]), (92, ""), (93, None)], "id long, text string")
    queries = spark.createDataFrame([(i, texts[i * 7]) for i in range(9)] + [(9, "none"), (10, None)], "query_id long, query_text string")
    if small:
        for name, n in (("POSTINGS", 100), ("WEIGHED", 3), ("HELD", 200)):
            monkeypatch.setattr(blocks, name, n)
    order = [F.desc("score"), F.asc("id")]
    row = lambda x: (x.query_id, x["rank"], x.id, x.score, x.len)
    best = R.bm25(docs, queries, top=5)
    assert "FlatMapCoGroupsInArrow" in best._jdf.queryExecution().toString()
    assert sorted(map(row, R.ranked(best, order, 5).collect())) == sorted(map(row, R.ranked(R.bm25(docs, queries), order, 5).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_all_scores_are_those_of_joins(spark, monkeypatch, small):
    """Ties, blank documents, ids that are null, a query that comes twice or has no hits; no pair of a document and a query is shuffled."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 20)}" for x in r.exponential(6, r.integers(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (90, texts[4]), (91, ""), (92, None), (None, texts[5])], "id long, text string")
    queries = spark.createDataFrame([(i, texts[i * 7]) for i in range(8)] + [(3, "w1 w2"), (9, "none"), (10, None), (None, "w3 w1")], "query_id long, query_text string")
    if small:
        for name, n in (("TERMS", 50), ("WEIGHED", 3), ("HELD", 200)):
            monkeypatch.setattr(blocks, name, n)
    key = lambda x: (str(x.query_id), str(x.id), x.score, str(x.len))
    found = [R.bm25(docs, queries), R.bm25(docs, queries, every=True)]
    assert not any("Exchange" in x._jdf.queryExecution().toString() for x in found)
    rows = [sorted(map(key, x.collect())) for x in found]
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", 0)  # by joins and shuffles
    plain = [R.bm25(docs, queries), R.bm25(docs, queries, every=True)]
    assert all("Exchange" in x._jdf.queryExecution().toString() for x in plain)
    assert rows == [sorted(map(key, x.collect())) for x in plain] and len(rows[1]) == 64 * 12


def test_bests_without_a_window(spark):
    """Every list meets its own best, one without an id too; the hits are not dealt by list."""
    hits = spark.createDataFrame([(q, i, float(i + (q or 0))) for q in (1, 2, None) for i in range(5)], "query_id long, id long, score double")
    found = R.normalised_scores(hits)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and found.columns == ["query_id", "id", "score", "norm_score"]
    best = {1: 5.0, 2: 6.0, None: 4.0}
    want = [(r.query_id, r.id, r.score, round(r.score / best[r.query_id] * 0.3, 6)) for r in hits.collect()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_postings_are_sorted_in_pieces(monkeypatch):
    """A task sorts a bounded number of tokens at once, whatever the batch has; the postings are the same."""
    import pyarrow as pa

    from foliospark.operators import textindex as X

    tokens = [["a", "b", "a"], [], ["c"] * 9, ["b"], ["a", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["text"] * 5), pa.array([len(t) for t in tokens], pa.int32()), pa.array(tokens, pa.list_(pa.string()))], ["id", "field", "len", "tokens"])
    key = lambda x: (x["id"], x["term"])
    rows = lambda: sorted((x for b in X._postings([batch]) for x in b.to_pylist()), key=key)
    whole = rows()
    monkeypatch.setattr(X, "MOST_TOKENS", 4)
    pieces = list(X._pieces([batch]))
    assert len(pieces) == 3 and all(len(p) == 1 or sum(map(len, p.column(3).to_pylist())) <= 4 for p in pieces)
    assert rows() == whole and len(whole) == 6
