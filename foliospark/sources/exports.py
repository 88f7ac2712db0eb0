"""Exports of library tables: BibTeX, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions import text as T

#: Columns of the CSV exports, in order, and the largest number of rows of an export.
PAPER_COLUMNS = ["id", "arxiv_id", "title", "authors", "abstract", "published", "pdf_url", "source", "ingest_status", "chunk_count"]
OWNED_PAPER_COLUMNS = [*PAPER_COLUMNS[1:], "owner_id", "created_at"]
QUERY_COLUMNS = ["id", "query_text", "answer_text", "lang", "hit_count", "created_at"]
OWNED_QUERY_COLUMNS = [*QUERY_COLUMNS[:5], "owner_id", "created_at"]
MOST, MOST_OWNED = 1000, 2000
#: What BibTeX needs escaped, in the order of replacement.
ESCAPES = [("\\", "\\\\"), ("%", "\\%"), ("&", "\\&"), ("#", "\\#"), ("$", "\\$"), ("_", "\\_"), ("~", "\\~{}"), ("^", "\\^{}")]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def bibtex() -> Column:
    """An entry: key, then title, author, year, eprint and url in double braces."""
    year = F.substring(_text("published"), 1, 4)
    fields = {
        "title": _text("title"), "author": _text("authors"), "year": F.when(year == "", "????").otherwise(year),
        "eprint": _text("arxiv_id"), "url": _text("pdf_url"),
    }
    key = T.bibtex_key(F.col("authors"), F.col("published"))
    lines = [F.concat(F.lit(f"  {name} = {{{{"), value, F.lit("}},\n")) for name, value in fields.items()]
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), *lines, F.lit("}"))


def escaped(c: Column) -> Column:
    """A BibTeX value: a pair of braces around it goes, braces within and special marks are escaped."""
    c = F.when(c.startswith("{") & c.endswith("}"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    for mark, instead in [("{", "\\{"), ("}", "\\}"), *ESCAPES]:
        c = F.replace(c, F.lit(mark), F.lit(instead))
    return c


def bibtex_escaped() -> Column:
    """The variant with the key ``paper:<arxiv_id, else id>``, an abstract and escaped marks; the year is the first four-digit run, else the date."""
    year = F.coalesce(F.nullif(T.first_year(_text("published")), F.lit("")), F.trim(_text("published")))
    fields = {
        "title": escaped(_text("title")), "author": escaped(_text("authors")), "abstract": escaped(_text("abstract")),
        "year": year, "arxivId": escaped(_text("arxiv_id")), "url": escaped(_text("pdf_url")),
    }
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")) for name, value in fields.items()])
    key = F.coalesce(F.col("arxiv_id"), F.col("id").cast("string"))
    return F.concat(F.lit("@article{paper:"), key, F.lit(",\n"), lines, F.lit("\n}"))


def csv_field(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[,"\n]'), quoted).otherwise(c), F.lit(""))


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in columns])


def newest(rows: DataFrame, limit: int | None, most: int) -> DataFrame:
    """The newest rows, ``limit`` (1 to ``most``) of them; all, without a limit."""
    if limit is None:
        return rows
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(most, max(1, limit)))


def _write(rows: DataFrame, path: str, form: str, columns: list[str], json: list[str], entry: Column | None) -> None:
    form = form.lower()
    if form == "csv":
        rows.select(*columns).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    elif form == "bibtex" and entry is not None:
        rows.select(entry.alias("value")).write.text(path, lineSep="\n\n")
    else:
        rows.select(*json).write.json(path, ignoreNullFields=False)


def write_papers(papers: DataFrame, path: str, form: str = "json", limit: int | None = None, owned: bool = False) -> None:
    """Writes papers as json, csv or bibtex; ``owned`` is the variant with owners and escaped entries. Any other form is json."""
    rows = newest(papers, limit, MOST_OWNED if owned else MOST)
    columns, entry = (OWNED_PAPER_COLUMNS, bibtex_escaped()) if owned else (PAPER_COLUMNS, bibtex())
    _write(rows, path, form, columns, ["id", *OWNED_PAPER_COLUMNS] if owned else papers.columns, entry)


def write_queries(queries: DataFrame, path: str, form: str = "json", limit: int | None = None, owned: bool = False) -> None:
    """Writes the query history as json or csv; any other form is json."""
    columns = OWNED_QUERY_COLUMNS if owned else QUERY_COLUMNS
    _write(newest(queries, limit, MOST_OWNED if owned else MOST), path, form, columns, columns, None)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export read back."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
