"""Text blocks made of ranked rows: contexts, overviews and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.text import preview, stripped


def joined(order: Column, line: Column, sep: str = "\n") -> Column:
    """An aggregate: the lines of a group in order. Groups are ranked lists of bounded length."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda s: s["l"]), sep)


#: What stands for no hits, for an unknown field, and the lines of an overview.
NO_CONTEXT, NO_HITS, UNKNOWN = "（无参考资料）", "（无结果）", "未知"
OVERVIEW_LINES = "[%d] %s | %s\n    作者: %s | 日期: %s\n    摘要: %s"


def _for_all(blocks: DataFrame, queries: DataFrame | None, none: str) -> DataFrame:
    """Also the queries without hits, if a table of queries is given."""
    if queries is None:
        return blocks
    return queries.select("query_id").join(blocks, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(none)))


def context_blocks(hits: DataFrame, n: int = 600, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context) from hits (query_id, rank, text and, where they have them, section, page, source).

    Each hit is a head that names what is known of it, and its text on one line, cut at ``n`` characters with an ellipsis."""
    has = lambda c, kind="string": F.col(c).cast(kind) if c in hits.columns else F.lit(None).cast(kind)
    named = lambda mark, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(mark), c)).otherwise("")
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"), named(" section=", has("section")),
                    named(" | page=", F.nullif(has("page"), F.lit("0"))), named(" | source=", has("source")))
    body = preview(F.replace(stripped(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")), n)
    block = F.concat(head, F.lit("\n"), body)
    return _for_all(hits.groupBy("query_id").agg(joined(F.col("rank"), block, "\n\n").alias("context")), queries, NO_CONTEXT)


def compact_blocks(hits: DataFrame, n: int = 400, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context) from hits (query_id, rank, arxiv_id, section, text): the short form."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), some("arxiv_id"), F.lit(" | "), some("section"), F.lit("\n"))
    block = F.concat(head, F.substring(stripped(some("text")), 1, n))
    return _for_all(hits.groupBy("query_id").agg(joined(F.col("rank"), block, "\n\n").alias("context")), queries, NO_HITS)


def overview(papers: DataFrame, n: int = 100) -> DataFrame:
    """(owner_id, overview): each owner's n newest papers, numbered, with authors, date and short abstracts."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("created_at"), F.desc("id")))
    rows = papers.withColumn("r", place).filter(F.col("r") <= n)
    some = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    line = F.format_string(
        OVERVIEW_LINES, "r", "arxiv_id", some("title", F.col("arxiv_id")), F.substring(some("authors", F.lit(UNKNOWN)), 1, 100),
        some("published", F.lit(UNKNOWN)), F.substring(F.coalesce("abstract", F.lit("")), 1, 300),
    )
    return rows.groupBy("owner_id").agg(joined(F.col("r"), line, "\n\n").alias("overview"))


def chosen_abstract(own: Column, section: Column, most: int = 3000) -> Column:
    """A paper's abstract: its own, else that of its first section of this name; cut with an ellipsis."""
    return preview(F.coalesce(F.nullif(own, F.lit("")), stripped(section), F.lit("")), most)


def chunk_texts(chunks: DataFrame, first: int = 30, each: int = 500, most: int | None = 8000) -> DataFrame:
    """(doc_id, text) of chunks (doc_id, chunk_no, text): the beginnings of a document's first chunks, where its full text lacks;
    cut at ``most`` characters with an ellipsis, or, with None, whole."""
    rows = chunks.filter(F.col("chunk_no") < first).groupBy("doc_id").agg(joined(F.col("chunk_no"), F.substring("text", 1, each), "\n\n").alias("text"))
    return rows if most is None else rows.select("doc_id", preview(F.col("text"), most).alias("text"))


def citation_report(out: DataFrame, most: int = 10) -> DataFrame:
    """(citing, report): the first ``most`` edges of each paper, those in the library marked."""
    from pyspark.sql import Window as W

    rows = out.withColumn("r", F.row_number().over(W.partitionBy("citing").orderBy("cited"))).filter(F.col("r") <= most)
    line = F.concat(F.lit("- "), F.col("cited").cast("string"), F.lit(" "), "title", F.when(F.col("in_db"), F.lit(" [in library]")).otherwise(""))
    return rows.groupBy("citing").agg(joined(F.col("r"), line).alias("report"))


#: The formats of report lines, and what stands for a missing field.
SEARCH_HEAD = "全文搜索 '%s' 找到 %d 篇："
SEARCH_LINE = "  • %s: %s\n    作者: %s | 日期: %s | 摘要: %s"
CITES_HEAD = "论文 %s 的引用关系：\n\n引用了 %d 篇论文："
CITED_HEAD = "\n被 %d 篇论文引用："
CITATION_LINE = "  %s %s: %s"
SIMILAR_HEAD = "与 %s 相似的论文 (%d 篇)："
SIMILAR_LINE = "  [%d] %s: %s\n      相似度: %.4f | 共同片段: %d"


def _below(head: Column, lines: Column) -> Column:
    """A head and the lines below it, if there are any."""
    return F.concat_ws("\n", head, F.nullif(lines, F.lit("")))


def search_lists(hits: DataFrame) -> DataFrame:
    """(query_id, report) of hits (query_id, query_text, rank, arxiv_id, title, authors, published, abstract)."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN))
    short = F.substring(F.coalesce("abstract", F.lit("")), 1, 150)
    line = F.format_string(SEARCH_LINE, "arxiv_id", F.coalesce("title", F.lit("")), known("authors"), known("published"), short)
    head = F.format_string(SEARCH_HEAD, F.first("query_text"), F.count("*"))
    return hits.groupBy("query_id").agg(_below(head, joined(F.col("rank"), line)).alias("report"))


def citation_lists(out: DataFrame, into: DataFrame, most: int = 10) -> DataFrame:
    """(id, report) of each paper with edges: totals, and the first ``most`` papers that it
    cites and that cite it, those in the library marked. ``out``: citing, cited, title, in_db
    of the cited; ``into``: cited, citing, title, in_db of the citing."""
    from pyspark.sql import Window as W

    def side(edges: DataFrame, id: str, other: str, name: str) -> DataFrame:
        n = edges.groupBy(id).agg(F.count("*").alias(f"n_{name}"))
        first = edges.withColumn("r", F.row_number().over(W.partitionBy(id).orderBy(other))).filter(F.col("r") <= most)
        badge = F.when(F.col("in_db"), "[DB]").otherwise("[WEB]")
        line = F.format_string(CITATION_LINE, badge, F.col(other).cast("string"), F.substring("title", 1, 80))
        lines = first.groupBy(id).agg(joined(F.col("r"), line).alias(name))
        return n.join(lines.hint("merge"), id).withColumnRenamed(id, "id")

    both = side(out, "citing", "cited", "cites").join(side(into, "cited", "citing", "cited_by").hint("merge"), "id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    cites = _below(F.format_string(CITES_HEAD, F.col("id").cast("string"), zero("n_cites")), F.col("cites"))
    cited = _below(F.format_string(CITED_HEAD, zero("n_cited_by")), F.col("cited_by"))
    return both.select("id", F.concat_ws("\n", cites, cited).alias("report"))


def recommendation_lists(similar: DataFrame) -> DataFrame:
    """(paper_id, report) of recommendations (paper_id, rank, arxiv_id, title, score, shared)."""
    line = F.format_string(SIMILAR_LINE, "rank", "arxiv_id", F.substring("title", 1, 80), "score", "shared")
    head = F.format_string(SIMILAR_HEAD, F.col("paper_id").cast("string"), F.count("*"))
    return similar.groupBy("paper_id").agg(_below(head, joined(F.col("rank"), line)).alias("report"))


def full_texts(sections: DataFrame, most: int = 8000) -> DataFrame:
    """(doc_id, text): section contents joined by blank lines, cut with an ellipsis."""
    text = joined(F.col("seq"), F.trim("content"), "\n\n")
    rows = sections.filter(F.trim("content") != "").groupBy("doc_id").agg(text.alias("text"))
    return rows.select("doc_id", preview(F.col("text"), most).alias("text"))


def pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b, status) of pairs to compare; an error where a text lacks."""
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rows.withColumn("status", F.when(F.col("text_a").isNotNull() & F.col("text_b").isNotNull(), "ok").otherwise("error: text not found"))
