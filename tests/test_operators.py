"""Literal cases and invariants of the library's operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import chunks as C, citations as X, embed as E, library as L, logs as G, retrieval as R, sections as S
from foliospark.streaming import keyed


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="BM25-like re_rank, a + 深度学习!") == ["bm25-like", "re_rank", "a", "深度学习"]
    assert one(spark, T.bigram_tokens(F.col("t")), t="深度学习 RAG") == ["深度", "度学", "学习", "rag"]


def test_language(spark):
    assert one(spark, T.language(F.col("t")), t="你好世界") == "zh" and one(spark, T.cjk_ratio(F.col("t")), t="你好世界") == 1.0
    assert one(spark, T.language(F.col("t")), t="") == "en"


def test_arxiv_ids(spark):
    text = "see arXiv:2401.00001v2, https://arxiv.org/abs/2305.12345, arXiv #1706.03762, x2301.00002y and 1999.1"
    assert one(spark, T.arxiv_ids(F.col("t")), t=text) == ["1706.03762", "2301.00002", "2305.12345", "2401.00001v2"]


def test_rate_limits(spark):
    for text, want in [("10/second", (10, 1)), ("100/hours", (100, 3600)), ("x/hour", (30, 3600)), ("5/week", (5, 60)), ("10/s", (10, 60)), ("7", (30, 60)), ("", (30, 60))]:
        n, s = T.rate_limit(F.col("t"))
        assert tuple(spark.createDataFrame([(text,)], "t string").select(n, s).first()) == want


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "attention mechanism in transformers attention"), (2, "graph networks"), (3, " ")], "id long, text string")
    queries = spark.createDataFrame([(7, "attention mechanism"), (8, "nothing here")], "query_id long, query_text string")
    got = R.bm25(docs, queries).collect()
    assert [(r.query_id, r.id) for r in got] == [(7, 1)] and got[0].score > 0


def test_reranking_by_a_pandas_function(spark):
    """A scorer may be any function of columns, also one over Arrow batches."""

    @F.pandas_udf("double")
    def shorter(query: pd.Series, document: pd.Series) -> pd.Series:
        return 1.0 / (1 + document.str.len())

    hits = spark.createDataFrame([(1, k, "q", "x" * (9 - k), 1.0 / k) for k in range(1, 8)], "query_id long, id long, query_text string, document string, score double")
    got = R.rerank(hits, 3, lambda q, d: shorter(q, d)).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 6, 5] and got[0].original_score == 1 / 7


def test_more_occurrences_score_higher(spark):
    docs = spark.createDataFrame([(k, " ".join(["cat"] * k + ["dog"] * (10 - k))) for k in range(1, 9)], "id long, text string")
    got = R.bm25(docs, spark.createDataFrame([(1, "cat")], "query_id long, query_text string")).orderBy("id").collect()
    assert [r.score for r in got] == sorted(r.score for r in got)


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, i, k) for k, i in enumerate([5, 6, 7], 1)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, i, k) for k, i in enumerate([7, 5, 9], 1)], "query_id int, id int, rank int")
    one_, two = R.rrf(a.union(b)), R.rrf(b.union(a))
    assert sorted(map(tuple, one_.collect())) == sorted(map(tuple, two.collect()))


def test_split_text():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["word ", "Sentence. ", "\n\n", "x" * r.randint(1, 90), "; ", "\n"]) for _ in range(r.randint(0, 200)))
        out = C.split_text(text, 100, 20)
        assert all(0 < len(c) <= 100 for c in out)
        assert set("".join(text.split())) == set("".join("".join(out).split()))
    assert C.split_text("", 100, 20) == [] and C.split_text(" \n ", 100, 20) == []


def test_blocks_stay_whole():
    code = "```\n" + "a = 1\n" * 30 + "```"
    text = "Before. " * 20 + code + " after $x^2$ and `code`." + " End." * 30
    out = C.split_text(text, 120, 20)
    assert any(code in c for c in out) and C.MARK not in "".join(out)


def test_blocks_survive_every_cut():
    """A block at each place around the cuts of text without separators, and marks of the text's own."""
    for at in range(80, 121):
        text = "x" * at + "`SECRET`" + C.MARK + "y" * 250 + "$$a `b` c$$"
        out = C.split_text(text, 100, 20)
        whole = "".join(out)
        assert "`SECRET`" in whole and C.MARK in whole and "$$a `b` c$$" in whole
        assert set(whole) == set(text) and whole.count("x") >= at and whole.count("y") >= 250


def test_long_texts_take_linear_time():
    import time

    text = ("word " * 30 + "`code` and $x$. ") * 25_000  # about 4 MB, 50,000 blocks
    began = time.process_time()
    out = C.split_text(text)
    assert sum(c.count("`code`") for c in out) >= 25_000 and time.process_time() - began < 20


def test_structured_chunks_say_where_they_stand(spark):
    sections = spark.createDataFrame([(1, 0, "Method", "Some text.", 3, "Method > Encoder", "Attention"), (1, 1, "End", " ", 0, "End", "Attention")],
                                     "doc_id long, seq long, title string, content string, page int, heading_path string, source string")
    tables = spark.createDataFrame([(1, 0, "| a |\n|---|", "Caption", 2, "Results", "Attention"), (2, 0, " ", "", 0, "", "")],
                                   "doc_id long, start int, markdown string, caption string, page int, section_title string, source string")
    got = C.structured(sections, tables).orderBy("doc_id", "chunk_no").collect()
    assert [(r.chunk_no, r.title, r.page, r.section_title, r.heading_path) for r in got] == [(0, "表格", 2, "Results", "Results > 表格"), (1, "Method", 3, "Method", "Method > Encoder")]
    assert got[0].text == "[上下文: 论文: Attention > Results > Results > 表格 (第2页)]\n\nCaption\n| a |\n|---|"
    assert got[1].text == "[上下文: 论文: Attention > Method > Method > Encoder (第3页)]\n\nSome text."


def test_many_subsections_keep_their_order(spark):
    from foliospark.sources import parsed

    sub = spark.range(1500).selectExpr("collect_list(named_struct('title', cast(id as string), 'page', 1, 'content', 'c')) as s")
    doc = sub.selectExpr("'p' as paper_id", "array(named_struct('title', 'A', 'page', 1, 'content', 'c', 'subsections', s), named_struct('title', 'B', 'page', 1, 'content', 'c', 'subsections', slice(s, 1, 0))) as sections")
    rows = parsed.flat_sections(doc).orderBy("seq").collect()
    assert [r.title for r in rows] == ["A", *map(str, range(1500)), "B"] and len({r.seq for r in rows}) == 1502


def test_reference_entries(spark):
    refs = "[1] The first of the entries here\n  [2] The second of the entries\n3. The third one of the entries\n[4] short"
    assert one(spark, T.reference_entries(F.col("t")), t=refs) == ["[1] The first of the entries here", "[2] The second of the entries", "3. The third one of the entries"]
    plain = "An entry without any number\n\nAnother entry without one\n\nx"
    assert one(spark, T.reference_entries(F.col("t")), t=plain) == ["An entry without any number", "Another entry without one"]


def test_entry_titles(spark):
    cases = [("[1] Smith, J. (2023). Deep nets.", "Smith, J"), ("2. Deep learning for all 2020. A title", "Deep learning for all 2020"),
             ("[3] Jones 2021, Graph networks revisited. Journal", ", Graph networks revisited"), ("题目一 2019 深度学习。 作者", "深度学习")]
    for entry, want in cases:
        assert one(spark, T.entry_title(F.col("t")), t=entry) == want


def test_errors_that_are_final(spark):
    cases = [("TimeoutError", "author list timed out", True), ("ValueError", "x", False), ("OSError", "Paper NOT FOUND", False), ("E", "文件不存在", False), ("PermissionError", "denied", True)]
    rows = spark.createDataFrame(cases, "kind string, message string, want boolean")
    assert rows.filter(T.retryable(F.col("kind"), F.col("message")) != F.col("want")).count() == 0


def test_citation_edges(spark):
    refs = "[1] Author, A. (2023). A long enough title here. arXiv:2401.00002v1\n[2] Own work again, long enough. arXiv:2401.00001v3\n[3] Author, B. (2022). Twice the same title. arXiv:2401.00002"
    rows = spark.createDataFrame([(1, refs)], "doc_id long, refs string")
    own = spark.createDataFrame([(1, "2401.00001v1")], "doc_id long, arxiv_id string")
    got = X.edges(rows, own).collect()
    assert [(r.citing, r.cited, r.cited_title) for r in got] == [("2401.00001v1", "2401.00002", "Author, A")]


def test_headings(spark):
    cases = [("Abstract", 10.0, True), ("Abstract", 9.5, False), ("2023", 14.0, False), ("3. Results", 8.0, True), ("A. Proofs", 8.0, True), ("3.2 Results", 9.0, True),
             ("4.", 12.0, False), ("2019. A year", 12.0, False), ("work in type", 12.0, False), ("Related Work", 10.0, True), ("plain words", 12.0, False)]
    rows = spark.createDataFrame(cases, "text string, size double, want boolean")
    assert rows.filter(S.is_heading(F.col("text"), F.col("size")) != F.col("want")).count() == 0


def test_sections_before_the_first_heading(spark):
    lines = [("Some words", 9.0), ("tiny", 5.0), ("1. Method", 6.0), ("a b", 9.0), (" ", 9.0), ("c", 9.0), ("2. Empty", 12.0)]
    rows = spark.createDataFrame([(d, k, t, s, d == 1) for d in (1, 2) for k, (t, s) in enumerate(lines)], "doc_id long, line_no int, text string, size double, titled boolean")
    got = sorted((r.doc_id, r.title, r.content) for r in S.sections(rows).collect())
    assert got == [(1, "1. Method", " a b c"), (1, "Abstract", "Some words"), (2, "1. Method", " a b c"), (2, "Preamble", "Some words")]


def test_outline(spark):
    lines = ["# A", "x", "## B", "#### C", "## D", "# E", "### F"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "doc_id long, line_no int, text string")
    got = S.outline(rows).orderBy("line_no").collect()
    assert [r.path for r in got] == ["A", "A > B", "A > B > C", "A > D", "E", "E > F"] and [r.content for r in got] == ["x", "", "", "", "", ""]


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", "V1"), (2, "b", "B")], "id long, arxiv_id string, title string")
    source = spark.createDataFrame([("a", "V2", 1), ("c", "C", 1), ("c", "C2", 2)], "arxiv_id string, title string, seq int")
    first = L.upsert(target, source)
    want = [(1, "a", "V2"), (2, "b", "B"), (3, "c", "C2")]
    assert sorted(map(tuple, first.select("id", "arxiv_id", "title").collect())) == want
    assert sorted(map(tuple, L.upsert(first, source).select("id", "arxiv_id", "title").collect())) == want


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    got = L.numbered(rows, 100, ["k"]).orderBy("k").collect()
    assert [r.id for r in got] == list(range(101, 5101))


def test_repeats_and_loops(spark):
    sig = ["s", "s", "s", "t", "s", "t", "s", "t", "s"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(sig, 1)], "user_id long, seq int, sig string")
    assert [r.seq for r in G.repeats(rows, "user_id", 2).filter("blocked").collect()] == [3]
    assert G.loops(rows, "user_id", most=2).filter("looping").count() == 3


def test_trimmed_keeps_first_and_users(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u")] + [(1, k, "tool", "x" * 3000) for k in range(2, 32)]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    out = G.trimmed(rows).orderBy("turn").collect()
    assert len(out) == 20 and [r.role for r in out[:2]] == ["system", "user"] and out[5].text == "x" * 2000 + G.CUT


def test_trimmed_takes_calls_with_their_answers(spark):
    group = lambda k: [(k, "assistant", [f"a{k}", f"b{k}"], None), (k + 1, "tool", None, f"a{k}"), (k + 2, "tool", None, f"b{k}")]
    turns = [(0, "system", None, None), (1, "user", None, None), *(x for k in range(2, 23, 3) for x in group(k)), (23, "user", None, None)]
    rows = spark.createDataFrame([(1, t, r, "x", c, a) for t, r, c, a in turns], "conv_id long, turn int, role string, text string, calls array<string>, answers string")
    assert [r.turn for r in G.trimmed(rows).orderBy("turn").collect()] == [0, 1, *range(8, 24)]


def events(spark):
    r = random.Random(9)
    rows = [(i, r.randint(1, 3), 1_700_000_000 + r.randint(0, 400)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts")


def fold(rows, new):
    out, state = {}, {}
    for i, u, s in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        out[i] = state.setdefault(u, new())(s * 1_000_000)
    return out


def test_admission_and_lifetime(spark):
    rows, df = events(spark)
    got = {r.event_id: r.admitted for r in keyed.admitted(df, 60, 5).collect()}
    assert got == fold(rows, lambda: keyed.Admission(60_000_000, 5)) and not all(got.values())
    got = {r.event_id: r.hit for r in keyed.ttl_hits(df, 60, key="user_id").collect()}
    assert got == fold(rows, lambda: keyed.Lifetime(60_000_000))


def test_mean_vectors_and_normalising(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "g int, embedding array<double>")
    got = {r.g: r.embedding for r in R.mean_vectors(rows, "g").collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    assert rows.filter("g = 2").select(R.normalised(F.col("embedding")).alias("v")).first().v == [0.0, 0.0]


def test_reuse_embeds_each_text_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    stored = E.hashed(rows.filter("id = 3").withColumn("key", T.content_key(F.lit("p"), F.col("text")))).select("key", "embedding")
    out, new = E.reused(rows, stored, "p", E.hashed)
    assert out.count() == 3 and new.count() == 1
