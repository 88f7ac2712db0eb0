"""From lines of text to sections, outlines and tables, by windows over line numbers.

All functions take (doc_id, line_no, text[, size]) rows. A window holds the
lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.functions.text import stripped

#: Titles that open a section if the type is large enough.
NAMES = [
    "references", "abstract", "acknowledgements", "acknowledgments", "conclusion", "conclusions", "supplementary material",
    "contents", "introduction", "related work", "related works", "background", "method", "methods", "methodology",
    "experiments", "experiment", "results", "discussion", "limitations", "appendix", "appendices",
]
#: Fixed value: the longest title.
LONGEST = 120
DEPTH = 6


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, text) of each line, from 0."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "text"))


#: What is no title (a bare number, a year, in a long line what a table of contents has), and what opens sections and subsections.
BARE_NUMBER = r"^\d+(\.\d+)?\.?\s*$"
YEAR = r"^(19|20)\d{2}[a-z]?$"
CONTENTS_LINE = r"\.{3,}|\bpp?\.\s*\d|\bvol\.?\s*\d|^\s*\d+\s*$"
SECTION_NUMBER = r"^(\d+\.|[A-Z]\.)\s*\S"
SUBSECTION_NUMBER = r"^(\d+\.\d+\.|[A-Z]\.\d+\.)\s*\S"


def heading_class(text: Column, size: Column) -> Column:
    """``section``, ``subsection`` or ``body`` for a line.

    A title is not too long, no bare number, year or line of a table of contents. A section begins
    with ``n.`` or ``A.``, or is a known name in large enough type; a subsection begins with
    ``n.m.`` or ``A.m.``. The rules are tried in this order, so numbers that end in a full stop open sections.
    """
    t = F.trim(text)
    word = F.regexp_replace(F.regexp_extract(t, r"^\S+", 0), r"\.+$", "")
    title = (
        (t != "") & (F.length(t) <= LONGEST) & ~t.rlike(BARE_NUMBER) & ~word.rlike(YEAR)
        & ~((F.length(t) > 50) & t.rlike(CONTENTS_LINE))
    )
    named = F.lower(t).isin(NAMES) & (size >= 10.0)
    section = title & (t.rlike(SECTION_NUMBER) | named)
    return F.when(section, "section").when(title & t.rlike(SUBSECTION_NUMBER), "subsection").otherwise("body")


def is_heading(text: Column, size: Column) -> Column:
    """Whether a line opens a section."""
    return heading_class(text, size) == "section"


def sections(rows: DataFrame, least_size: float = 6.5) -> DataFrame:
    """(doc_id, seq, title, content): content gathers under the last heading.

    Lines before the first heading belong to ``Abstract`` where the rows' column ``titled`` says
    that the document has a title, else to ``Preamble``; sections without content are dropped, as
    are lines of text in smaller type than ``least_size``.
    """
    order = W.partitionBy("doc_id").orderBy("line_no")
    marked = rows.withColumn("h", is_heading(F.col("text"), F.col("size"))).filter(F.col("h") | (F.col("size") >= least_size))
    marked = marked.withColumn("seq", F.sum(F.col("h").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("h") & (F.trim("text") != ""), F.struct("line_no", F.trim("text").alias("text")))))
    before = F.when(F.max("titled"), "Abstract").otherwise("Preamble") if "titled" in rows.columns else F.lit("Preamble")
    joined = F.array_join(F.transform(body, lambda s: s["text"]), " ")
    grouped = marked.groupBy("doc_id", "seq").agg(
        F.coalesce(F.max(F.when(F.col("h"), F.trim("text"))), before).alias("title"),
        # What follows a heading begins with a blank, as each line adds one before it.
        F.when((F.col("seq") > 0) & (joined != ""), F.concat(F.lit(" "), joined)).otherwise(joined).alias("content"),
    )
    return grouped.filter("content <> ''")


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, size): the spans of a line joined, with the first one's size."""
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    return spans.groupBy("doc_id", "line_no").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("text"), F.min_by("size", "span_no").alias("size")
    )


#: A Markdown heading, a line of a table, a table on one line.
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+)$"
TABLE_LINE = r"^\|.+\|$"
HTML_TABLE_LINE = r"(?is)^<table[^>]*>.*?</table>"


def outline(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title, path, content, tables) of the Markdown headings among the lines.

    ``path`` names the ancestors: for each level above, the last heading before
    this line that no shallower heading has closed. Below a heading and before the next one, table
    lines, with the blank lines after them, are the ``tables``; what stands between
    them is the ``content``: parts without blank ends and without more than one blank line in a row, joined by blank lines.
    """
    order = W.partitionBy("doc_id").orderBy("line_no")
    before = order.rowsBetween(W.unboundedPreceding, 0)
    level = F.length(F.regexp_extract("text", MARKDOWN_HEADING, 1))
    bare = stripped(F.col("text"))
    table = bare.rlike(TABLE_LINE) | bare.rlike(HTML_TABLE_LINE)
    kind = F.when(F.col("level") > 0, "head").when(table, "table").when(bare != "", "text")
    numbered = rows.withColumn("level", level).withColumn("kind", F.last(kind, ignorenulls=True).over(before))
    numbered = numbered.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(order))
    head = F.col("level") > 0
    # A run is a stretch of lines inside or outside a table; a blank line belongs to what stands before it.
    inside = F.col("kind") == "table"
    turned = head | (inside != F.coalesce(F.lag(inside).over(order), F.lit(False)))
    numbered = numbered.withColumn("inside", inside).withColumn("run", F.sum(turned.cast("int")).over(order))
    lines_ = F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "text"))))
    runs = numbered.filter("part > 0").groupBy("doc_id", "part", "run").agg(
        F.min(F.when(head, F.col("line_no"))).alias("line_no"), F.max("level").alias("level"), F.max("inside").alias("inside"),
        F.max(F.when(head, stripped(F.regexp_extract("text", MARKDOWN_HEADING, 2)))).alias("title"),
        F.array_join(F.transform(lines_, lambda s: s["text"]), "\n").alias("text"),
    )
    clean = stripped(F.regexp_replace("text", r"\n{3,}", "\n\n"))
    kept = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("run", c.alias("t"))))), lambda s: s["t"])
    heads = runs.groupBy("doc_id", "part").agg(
        F.max("line_no").alias("line_no"), F.max("level").alias("level"), F.max("title").alias("title"),
        F.array_join(kept(clean, ~F.col("inside") & (clean != "")), "\n\n").alias("content"), kept(F.col("text"), F.col("inside")).alias("tables"),
    )
    for l in range(1, DEPTH + 1):
        last = F.max(F.when(F.col("level") == l, F.struct("line_no", "title"))).over(before)
        heads = heads.withColumn(f"a{l}", last)
    path, floor = [], F.lit(-1)
    for l in range(1, DEPTH + 1):
        a = F.col(f"a{l}")
        open_ = a.isNotNull() & (F.col("level") >= l) & (a["line_no"] > floor)
        path.append(F.when(open_, a["title"]))
        floor = F.when(a.isNotNull(), F.greatest(floor, a["line_no"])).otherwise(floor)
    return heads.select("doc_id", "line_no", "level", "title", F.concat_ws(" > ", *path).alias("path"), "content", "tables")


def markdown_tables(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_lines, markdown) of runs of pipe lines whose second is a separator."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    pipes = rows.withColumn("t", F.trim("text")).filter(F.col("t").rlike(r"^\|.*\|$"))
    runs = pipes.withColumn("run", F.col("line_no") - F.row_number().over(order))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "t")))
    tables = runs.groupBy("doc_id", "run").agg(
        F.min("line_no").alias("start"), F.count("*").alias("n_lines"), F.transform(ordered, lambda s: s["t"]).alias("ls")
    )
    good = tables.filter((F.col("n_lines") >= 2) & F.col("ls")[1].rlike(r"^\|[\s:|-]+\|$"))
    return good.select("doc_id", "start", "n_lines", F.array_join("ls", "\n").alias("markdown"))


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, markdown) of the tables in HTML."""
    table = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "body")
    rows = F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " "))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), strip)
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    out = pages.select("page_id", table).withColumn("rows", F.filter(F.transform(rows, cells), lambda r: F.size(r) > 0)).filter(F.size("rows") > 0)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.col("rows")[0])))
    rest = F.transform(F.slice("rows", 2, F.size("rows")), line)
    return out.select("page_id", "table_no", F.array_join(F.concat(F.array(line(F.col("rows")[0]), rule), rest), "\n").alias("markdown"))
