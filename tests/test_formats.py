"""Blocks, digests, outlines and exports by literal cases."""

import csv
import io

from pyspark.sql import functions as F

from foliospark.operators import logs as G, reports as P, sections as S
from foliospark.sources import exports as X


def test_context_blocks(spark):
    rows = [
        (1, 1, "Method", 3, "arxiv", "  one\ntwo  "), (1, 2, "", 0, None, "x" * 601), (1, 3, None, None, "s", None),
        (2, 1, "A", None, "", "y"),
    ]
    hits = spark.createDataFrame(rows, "query_id long, rank int, section string, page int, source string, text string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r.context for r in P.context_blocks(hits, queries=queries).collect()}
    assert got[1] == "[1] section=Method | page=3 | source=arxiv\none two\n\n[2]\n" + "x" * 600 + "…\n\n[3] | source=s\n"
    assert got[2] == "[1] section=A\ny" and got[3] == "（无参考资料）"
    short = hits.withColumn("arxiv_id", F.when(F.col("rank") == 1, "2401.1"))
    got = {r.query_id: r.context for r in P.compact_blocks(short, 5, queries).collect()}
    assert got == {1: "[1] 2401.1 | Method\none\nt\n\n[2]  | \nxxxxx\n\n[3]  | \n", 2: "[1] 2401.1 | A\ny", 3: "（无结果）"}


def test_overview(spark):
    rows = [("u", 1, 1, "2401.1", "T", "A, B", "2024-01-02", "about"), ("u", 2, 2, "2401.2", None, "", None, None)]
    papers = spark.createDataFrame(rows, "owner_id string, id long, created_at long, arxiv_id string, title string, authors string, published string, abstract string")
    got = P.overview(papers).first().overview
    assert got == "[1] 2401.2 | 2401.2\n    作者: 未知 | 日期: 未知\n    摘要: \n\n[2] 2401.1 | T\n    作者: A, B | 日期: 2024-01-02\n    摘要: about"


def test_digest(spark):
    rows = [
        (1, 0, "system", "s", None), (1, 1, "user", "u" * 150, None), (1, 2, "assistant", "", ["c1"]), (1, 3, "tool", "found", None),
        (1, 4, "assistant", "a" * 90, []), (1, 5, "other", "x", None), (2, 0, "user", None, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, calls array<string>")
    got = {r.conv_id: r.digest for r in G.digest(turns).collect()}
    assert got == {1: "[系统提示]\n[用户] " + "u" * 100 + "\n[助手调用工具] \n[工具结果]\n[助手] " + "a" * 80, 2: "[用户] "}


def test_outline_tables(spark):
    text = "before\n# A  \n\none\n\n\n\ntwo\n| a | b |\n|---|---|\n\n| 1 | 2 |\n\nthree\n## B\n<table><tr></tr></table>\n\nfour\n##\n#  \n#  C"
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(text.split("\n"))], "doc_id long, line_no int, text string")
    got = [(r.title, r.path, r.content, r.tables) for r in S.outline(rows).orderBy("line_no").collect()]
    assert got == [
        ("A", "A", "one\n\ntwo\n\nthree", ["| a | b |\n|---|---|\n\n| 1 | 2 |\n"]),
        ("B", "A > B", "four\n##", ["<table><tr></tr></table>\n"]),
        ("", "", "", []),
        ("C", "C", "", []),
    ]


def test_abstracts_and_chunk_texts(spark):
    rows = spark.createDataFrame([("own", "s"), ("", "  section  "), (None, None), ("x" * 3001, "s")], "own string, section string")
    got = [r[0] for r in rows.select(P.chosen_abstract(F.col("own"), F.col("section"))).collect()]
    assert got == ["own", "section", "", "x" * 3000 + "…"]
    chunks = spark.createDataFrame([(1, k, f"{k}" * 600) for k in range(40)], "doc_id long, chunk_no int, text string")
    whole = "\n\n".join((f"{k}" * 600)[:500] for k in range(30))
    assert P.chunk_texts(chunks).first().text == whole[:8000] + "…"


PAPER = "id long, arxiv_id string, title string, authors string, abstract string, published string, pdf_url string, source string, ingest_status string, chunk_count int, owner_id string, created_at long"


def test_exports(spark, tmp_path):
    rows = [(1, "2401.1", 'A "b", c', "Ann Lee, Bo", "x\ny", "2024-01-02", "http://u", "s", "pending", 3, "u", 5), (2, "2401.2", "{T_1 50%}", None, None, None, None, None, "failed", 0, None, 9)]
    papers = spark.createDataFrame(rows, PAPER)
    entries = {r.id: r.e for r in papers.select("id", X.bibtex().alias("e")).collect()}
    assert entries[1] == '@article{Lee2024,\n  title = {{A "b", c}},\n  author = {{Ann Lee, Bo}},\n  year = {{2024}},\n  eprint = {{2401.1}},\n  url = {{http://u}},\n}'
    assert entries[2].startswith("@article{Unknown0000,") and "year = {{????}}" in entries[2]
    owned = {r.id: r.e for r in papers.select("id", X.bibtex_escaped().alias("e")).collect()}
    assert owned[2] == "@article{paper:2401.2,\n  title = {T\\_1 50\\%},\n  author = {},\n  abstract = {},\n  year = {},\n  arxivId = {2401.2},\n  url = {}\n}"
    X.write_papers(papers.coalesce(1), f"{tmp_path}/csv", "CSV")
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part")]
    read = list(csv.reader(io.StringIO(part.read_text())))
    assert read[0] == X.PAPER_COLUMNS and read[1] == ["1", "2401.1", 'A "b", c', "Ann Lee, Bo", "x\ny", "2024-01-02", "http://u", "s", "pending", "3"]
    X.write_papers(papers, f"{tmp_path}/json", "odd", limit=0, owned=True)
    back = spark.read.schema(PAPER).json(f"{tmp_path}/json").collect()
    assert [r.id for r in back] == [2] and back[0].title is not None and back[0].authors is None
    assert papers.filter("id = 1").select(X.csv_line(["title", "abstract", "owner_id"])).first()[0] == '"A ""b"", c","x\ny",u'
