"""Scans of parsed documents, metadata feeds and TEI files, and metadata expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SUB = "struct<title:string,page:int,content:string>"
DOCUMENT = (
    "metadata struct<title:string,authors:array<string>,abstract:string,source:string,arxiv_id:string>, "
    f"sections array<struct<title:string,page:int,content:string,subsections:array<{_SUB}>>>, "
    "tables array<struct<caption:string,page:int,markdown:string>>"
)
ENTRY = ("id string, title string, summary string, published string, author array<struct<name:string>>, "
         "category array<struct<_term:string>>, link array<struct<_href:string,_type:string,_title:string>>")  # fmt: skip
#: Levels of divisions below a section that a TEI scan keeps; deeper ones go with their text.
TEI_DEPTH = 4
_FIGURE = "struct<_type:string,_foliopage:int,figDesc:string,table:struct<row:array<struct<cell:array<string>>>>>"


def _division(depth: int) -> str:
    inner = f",div:array<{_division(depth - 1)}>" if depth else ""
    return f"struct<_foliopage:int,head:string,p:array<string>,figure:array<{_FIGURE}>{inner}>"


_AUTHOR = "struct<persName:struct<forename:array<string>,surname:string>>"
TEI = ("teiHeader struct<fileDesc:struct<titleStmt:struct<title:string>,"
       f"sourceDesc:struct<biblStruct:struct<analytic:struct<author:array<{_AUTHOR}>>>>>,profileDesc:struct<abstract:string>>, "
       f"text struct<body:struct<div:array<{_division(TEI_DEPTH + 1)}>,figure:array<{_FIGURE}>>>")  # fmt: skip
#: The elements of a TEI body that a scan reads; others give their text to what they stand in.
BODY_TAGS = "body|div|head|p|figure|figDesc|table|row|cell"
#: Names of TEI sections that aren't body text.
NOT_BODY = ["references", "bibliography", "acknowledgements", "acknowledgments", "appendix", "appendices", "supplementary material"]


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each well-formed JSON document below a folder; ``paper_id`` is the file's stem."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("paper_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def flat_sections(parsed: DataFrame, id: str = "paper_id") -> DataFrame:
    """(doc_id, seq, title, page, content): sections and their subsections in order."""
    top = parsed.select(F.col(id).alias("doc_id"), F.posexplode("sections").alias("i", "s"))
    sub = F.coalesce("s.subsections", F.array().cast(f"array<{_SUB}>"))
    all_ = F.concat(F.array(F.struct(F.col("s.title"), F.col("s.page"), F.col("s.content"))), sub)
    rows = top.select("doc_id", "i", F.posexplode(all_).alias("j", "x"))
    return rows.select("doc_id", (F.col("i").cast("long") * (1 << 32) + F.col("j")).alias("seq"), F.coalesce("x.title", F.lit("Untitled")).alias("title"), "x.page", "x.content")


def read_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of Atom feeds as paper rows; ``lines``: one entry on each line, without a root."""
    e = spark.read.format("xml").option("rowTag", "entry").option("multiLine", not lines).schema(ENTRY).load(path)
    is_pdf = lambda x: (x["_type"] == "application/pdf") | x["_href"].endswith(".pdf") | (x["_title"] == "pdf")
    arxiv_id = F.element_at(F.split("id", "/"), -1)
    pdf = F.try_element_at(F.filter("link", lambda x: F.coalesce(is_pdf(x), F.lit(False))), F.lit(1))["_href"]
    return e.select(
        arxiv_id.alias("arxiv_id"), F.trim(F.regexp_replace("title", r"\s*\n\s*", " ")).alias("title"),
        F.array_join(F.transform("author", lambda a: a["name"]), ", ").alias("authors"), F.trim("summary").alias("abstract"),
        "published", F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.try_element_at("category", F.lit(1))["_term"].alias("primary_category"),
        F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id)).alias("pdf_url"),
    )


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _list(c: Column, of: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{of}>"))


def _lines(ps: Column) -> Column:
    """The paragraphs that aren't blank, in one line."""
    return F.array_join(F.filter(F.transform(ps, _clean), lambda x: x != ""), " ")


def _inline(xml: Column) -> Column:
    """A TEI document whose body has the scan's elements alone, each division and figure with its page: that of
    the last page break before it, else of the document's first, else 1."""
    breaks = r"<(?:\w+:)?pb\b[^>]*>"
    number = lambda tag: F.coalesce(F.regexp_extract(tag, r"""\b(?:n|xml:id)=["'](\d+)["']""", 1).try_cast("int"), F.lit(1))
    pages = F.transform(F.regexp_extract_all(xml, F.lit(breaks), F.lit(0)), number)
    first = F.coalesce(F.get(pages, F.lit(0)), F.lit(1))
    paged = lambda part, i: F.regexp_replace(
        part, F.lit(r"<((?:\w+:)?(?:div|figure))\b"), F.concat(F.lit('<$1 foliopage="'), F.coalesce(F.get(pages, i - 1), first).cast("string"), F.lit('"'))
    )
    whole = F.array_join(F.transform(F.split(xml, breaks), paged), "")
    at = F.locate("<body", whole)
    inside = F.regexp_replace(F.substring(whole, at, F.length(whole)), rf"</?(?!(?:{BODY_TAGS}|text|back|TEI)\b)[A-Za-z][^<>]*>", "")
    header = F.substring(whole, F.lit(1), at - 1)
    flat = F.regexp_replace(F.regexp_extract(header, r"(?s)<abstract\b[^>]*>(.*?)</abstract>", 1), r"<[^>]*>", "")
    header = F.concat(F.regexp_replace(header, r"(?s)<abstract\b[^>]*>.*?</abstract>", "<abstract></abstract>"))
    header = F.replace(header, F.lit("<abstract></abstract>"), F.concat(F.lit("<abstract>"), flat, F.lit("</abstract>")))
    return F.when(at > 0, F.concat(header, inside)).otherwise(xml)


def read_tei(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(title, authors, abstract, sections, tables, figures) of TEI documents, one in each file, or on each line if ``lines`` is set.

    A division of the body that has divisions gives these as sections, and its tables and
    figures go before the body's own; theirs are subsections: ``subsections`` has the first level, and ``deeper`` all further ones in
    order, with their level. Sections outside the body text are left out, with all below them. Inner marks of a paragraph leave
    their text. Files that aren't well-formed are left out.
    """
    raw = spark.read.text(path, wholetext=not lines)
    d = raw.select(F.from_xml(_inline(F.col("value")), TEI, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("t")).select("t.*")
    d = d.filter("teiHeader is not null or text is not null")
    body = lambda x: ~F.lower(x["title"]).isin(NOT_BODY)
    page = lambda x: F.coalesce(x["_foliopage"], F.lit(1))

    def flat(x: Column, level: int | None = None) -> Column:
        names = [_clean(x["head"]).alias("title"), page(x).alias("page"), F.coalesce(_lines(x["p"]), F.lit("")).alias("content")]
        return F.struct(*([F.lit(level).alias("level")] if level else []), *names)

    def below(xs: Column, depth: int, level: int) -> Column:
        """The divisions and all theirs, in order of the document."""
        one = lambda x: F.when(body(flat(x)), F.concat(F.array(flat(x, level)), below(x["div"], depth - 1, level + 1) if depth else F.array().cast(deep))).otherwise(F.array().cast(deep))
        return F.flatten(F.transform(_list(xs, _division(depth)), one))

    deep = "array<struct<level:int,title:string,page:int,content:string>>"
    first = lambda xs: F.filter(F.transform(xs, lambda y: flat(y)), body)

    def section(x: Column, depth: int | None) -> Column:
        subs = first(_list(x["div"], _division(depth))) if depth is not None else F.array().cast("array<struct<title:string,page:int,content:string>>")
        further = F.filter(below(x["div"], depth, 1), lambda y: y["level"] > 1) if depth is not None else F.array().cast(deep)
        return F.struct(_clean(x["head"]).alias("title"), page(x).alias("page"), F.coalesce(_lines(x["p"]), F.lit("")).alias("content"), subs.alias("subsections"), further.alias("deeper"))

    split = lambda x: F.size(_list(x["div"], _division(TEI_DEPTH))) > 0
    each = lambda x: F.when(split(x), F.transform(x["div"], lambda y: section(y, TEI_DEPTH - 1))).otherwise(F.array(section(x, None)))
    divs = _list(F.col("text.body.div"), _division(TEI_DEPTH + 1))
    sections = F.filter(F.flatten(F.transform(divs, each)), body)
    name = lambda a: F.trim(F.concat_ws(" ", F.array_join(F.filter(F.transform(_list(a["persName"]["forename"], "string"), F.trim), lambda x: x != ""), " "), F.trim(a["persName"]["surname"])))
    authors = F.filter(F.transform(_list(F.col("teiHeader.fileDesc.sourceDesc.biblStruct.analytic.author"), _AUTHOR), name), lambda x: x != "")
    owned = lambda x: F.transform(_list(x["figure"], _FIGURE), lambda f: F.struct(f.alias("f"), _clean(x["head"]).alias("of")))
    inside = F.flatten(F.transform(F.filter(divs, split), owned))
    found = F.concat(inside, F.transform(_list(F.col("text.body.figure"), _FIGURE), lambda f: F.struct(f.alias("f"), F.lit("").alias("of"))))
    is_table = lambda g: F.coalesce(g["f"]["_type"] == "table", F.lit(False))
    cells = lambda f: F.transform(f["table"]["row"], lambda r: F.transform(_list(r["cell"], "string"), _clean))
    markdown = lambda f: F.when(F.size(cells(f)) > 0, table_markdown(cells(f))).otherwise("")
    return d.select(
        _clean(F.col("teiHeader.fileDesc.titleStmt.title")).alias("title"), authors.alias("authors"),
        _clean(F.col("teiHeader.profileDesc.abstract")).alias("abstract"), sections.alias("sections"),
        F.transform(F.filter(found, is_table), lambda g: F.struct(_clean(g["f"]["figDesc"]).alias("caption"), page(g["f"]).alias("page"), markdown(g["f"]).alias("markdown"))).alias("tables"),
        F.transform(F.filter(found, lambda g: ~is_table(g)), lambda g: F.struct(_clean(g["f"]["figDesc"]).alias("caption"), page(g["f"]).alias("page"), g["of"].alias("section_title"))).alias("figures"),
    )


def table_markdown(rows: Column) -> Column:
    """A Markdown table from an array of arrays of cells; the first row is the head."""
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n")


def markdown_metadata(md: Column) -> tuple[Column, Column]:
    """(title, abstract): the first h1; the Abstract section up to 3000 characters, or the
    first paragraph below the title up to 500."""
    title = F.trim(F.regexp_extract(md, r"(?m)^#[ \t]+(.+)$", 1))
    section = F.trim(F.regexp_extract(md, r"(?ims)^#+[ \t]*abstract[ \t]*\n(.*?)(?=^#|\z)", 1))
    first = F.regexp_extract(md, r"(?s)^#[^\n]*\n\n(.*?)(?:\n\n|\z)", 1)
    abstract = F.when(section != "", F.substring(section, 1, 3000)).otherwise(F.substring(first, 1, 500))
    return title.alias("title"), abstract.alias("abstract")
