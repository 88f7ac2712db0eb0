"""The library's tool functions over tables of keys: each gives one text for each paper, pair or query asked for.

search: ``modes.search`` with ``reports.search_lists``, ``semantic_lists`` or ``library_lists``; get_paper: ``paper_details``;
summarize_paper: ``summary_inputs``; get_citations: ``reports.citation_lists``; compare_papers: ``comparison_inputs``;
recommend_similar: ``reports.recommendation_lists``; generate_survey: ``modes.survey_inputs`` and ``exported``.
What a language model would make of the inputs is not part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.operators import reports as P
from foliospark.operators.retrieval import small
from foliospark.sources import exports as X

#: The texts of the tools, and what stands for a missing field.
DETAILS = "arXiv ID: %s\n标题: %s\n作者: %s\n摘要: %s\n发布日期: %s\n来源: %s\n入库状态: %s | chunks: %d\nPDF: %s"
NO_PAPER, NO_ABSTRACT, NO_LINK = "未找到论文: %s", "（无摘要）", "无"
PASSAGE, NO_PASSAGES, NOT_KNOWN = "[%d] %s | %s | p.%s\n  %s", "未找到语义相关的论文片段。", "?"
LIBRARY_HEAD, LIBRARY_LINE, EMPTY_LIBRARY = "共 %d 篇论文：", "  • %s: %s", "暂无已入库论文。"
NO_TEXT = "[ERROR] 未找到解析文件且向量库中也无分块数据：%s"
NOTHING = "未找到与 '%s' 相关的论文。"
EXPORT_COLUMNS = ["id", "arxiv_id", "title", "authors", "abstract", "published", "source", "ingest_status"]
#: Fixed value: chunks that are given of a paper at most.
MOST_CHUNKS = 500


def _some(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))


def paper_details(keys: DataFrame, papers: DataFrame) -> DataFrame:
    """(arxiv_id, report) of a table of keys (arxiv_id): all that is known of a paper."""
    found = papers.withColumn("__here", F.lit(True)).hint("merge")
    text = F.format_string(
        DETAILS, "arxiv_id", F.coalesce("title", F.lit("")), _some("authors", P.UNKNOWN), _some("abstract", NO_ABSTRACT), _some("published", P.UNKNOWN),
        F.coalesce("source", F.lit("")), F.coalesce("ingest_status", F.lit("")), F.coalesce("chunk_count", F.lit(0)), _some("pdf_url", NO_LINK),
    )
    rows = keys.select("arxiv_id").distinct().join(found, "arxiv_id", "left")
    return rows.select("arxiv_id", F.when(F.col("__here"), text).otherwise(F.format_string(NO_PAPER, "arxiv_id")).alias("report"))


def semantic_lists(hits: DataFrame, queries: DataFrame, n: int = 400) -> DataFrame:
    """(query_id, report) of ranked passages (query_id, rank, arxiv_id, section, page, text)."""
    flat = F.replace(F.substring(F.coalesce("text", F.lit("")), 1, n), F.lit("\n"), F.lit(" "))
    page = F.coalesce(F.col("page").cast("string"), F.lit(NOT_KNOWN))
    line = F.format_string(PASSAGE, "rank", F.coalesce("arxiv_id", F.lit(NOT_KNOWN)), F.coalesce("section", F.lit("")), page, flat)
    found = hits.groupBy("query_id").agg(P.joined(F.col("rank"), line, "\n\n").alias("report"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("report", F.coalesce("report", F.lit(NO_PASSAGES)))


def library_lists(papers: DataFrame, top: int = 5) -> DataFrame:
    """(owner_id, report): the number of each owner's ingested papers, and the newest."""
    rows = papers.filter("ingest_status = 'ingested'")
    place = F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("created_at"), F.desc("id")))
    first = rows.select("owner_id", "arxiv_id", "title", "created_at", "id").withColumn("r", place).filter(F.col("r") <= top)
    line = F.format_string(LIBRARY_LINE, "arxiv_id", F.substring(F.coalesce("title", F.lit("")), 1, 80))
    lines = first.groupBy("owner_id").agg(P.joined(F.col("r"), line).alias("lines"))
    counts = papers.groupBy("owner_id").agg(F.count_if(F.col("ingest_status") == "ingested").alias("n"))
    text = F.concat_ws("\n", F.format_string(LIBRARY_HEAD, "n"), "lines")
    return counts.join(lines.hint("merge"), "owner_id", "left").select("owner_id", F.when(F.col("n") > 0, text).otherwise(EMPTY_LIBRARY).alias("report"))


def chunks_of(keys: DataFrame, chunks: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """The first ``most`` chunks of each paper asked for (arxiv_id), by chunk_no."""
    asked = small(keys.select("arxiv_id").distinct())
    place = F.row_number().over(W.partitionBy("arxiv_id").orderBy("chunk_no"))
    return chunks.join(asked, "arxiv_id", "left_semi").withColumn("__r", place).filter(F.col("__r") <= most).drop("__r")


def summary_inputs(keys: DataFrame, full_texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(arxiv_id, text, found) for papers asked for: the full text (arxiv_id, text), else the beginnings of its first
    chunks (arxiv_id, chunk_no, text), else what says that there are none."""
    asked = keys.select("arxiv_id").distinct()
    whole = asked.join(full_texts.select("arxiv_id", F.col("text").alias("whole")).hint("merge"), "arxiv_id", "left")
    lacking = whole.filter("whole is null").select("arxiv_id")
    parts = P.chunk_texts(chunks_of(lacking, chunks.select("arxiv_id", "chunk_no", "text"), 100).withColumnRenamed("arxiv_id", "doc_id")).select(F.col("doc_id").alias("arxiv_id"), F.col("text").alias("parts"))
    text = F.coalesce("whole", "parts")
    rows = whole.join(parts.hint("merge"), "arxiv_id", "left")
    return rows.select("arxiv_id", F.coalesce(text, F.format_string(NO_TEXT, "arxiv_id")).alias("text"), text.isNotNull().alias("found"))


def comparison_inputs(pairs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b, status) of pairs of papers, from ``summary_inputs`` of both sides."""
    return P.pair_texts(pairs, inputs.filter("found").select(F.col("arxiv_id").alias("doc_id"), "text"))


def exported(hits: DataFrame, queries: DataFrame, form: str = "json") -> DataFrame:
    """(query_id, export) of the papers that a query has found, by rank, as one json, csv or bibtex text.

    ``hits``: query_id, rank and the papers' columns; ``queries``: query_id, query_text."""
    if form == "bibtex":
        line, sep, head = X.bibtex(), "\n\n", None
    elif form == "csv":
        line, sep, head = X.csv_line(EXPORT_COLUMNS), "\n", ",".join(EXPORT_COLUMNS)
    else:
        line, sep, head = F.to_json(F.struct(*[c for c in X.PAPER_COLUMNS]), {"ignoreNullFields": "false"}), ",\n", None
    text = P.joined(F.col("rank"), line, sep)
    text = F.concat(F.lit(head + "\n"), text) if head else F.concat(F.lit("[\n"), text, F.lit("\n]")) if form == "json" else text
    found = hits.groupBy("query_id").agg(text.alias("export"))
    rows = queries.select("query_id", "query_text").join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce("export", F.format_string(NOTHING, "query_text")).alias("export"))
