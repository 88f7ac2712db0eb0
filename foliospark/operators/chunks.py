"""Chunking: documents to pieces for embedding.

``fixed`` is a plain expression. ``split`` protects special blocks and prefers
paragraph, line and sentence ends; it runs in Arrow batches, one row to many.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.functions import udtf

SIZE, OVERLAP = 1000, 200
#: Separators in order of preference.
SEPARATORS = ["\n\n", "\n", ". ", "; ", " "]
#: Blocks that are kept whole, in the order of masking.
BLOCKS = [r"```.*?```", r"\$\$.*?\$\$", r"(?i)<table\b.*?</table>", r"(?:^\|[^\n]*\|[ \t]*\n?){2,}", r"`[^`\n]+`", r"\$[^$\n]+\$"]


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, text): windows of ``size`` characters every ``size - overlap``."""
    n = F.greatest(F.length("text"), F.lit(1))
    starts = F.sequence(F.lit(1), n, F.lit(size - overlap))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "at")).select(
        "doc_id", "chunk_no", F.substr("text", F.col("at"), F.lit(size)).alias("text")
    )


#: Stands for a protected block while a text is cut: one character, so no cut goes through it.
#: Where a text has this character itself, it is a block of its own.
MARK = "\U000F0000"


def mask(text: str) -> tuple[str, list[str]]:
    """The text with a mark for each protected block, and the blocks in order."""
    kept = [MARK] * text.count(MARK)
    for pattern in BLOCKS:
        out: list[str] = []
        blocks: list[str] = []
        at = used = 0
        for m in re.finditer(pattern, text, flags=re.S | re.M):
            gap = text[at : m.start()]
            upto = used + gap.count(MARK)
            inside = upto + m[0].count(MARK)
            blocks += kept[used:upto]
            blocks.append(restore(m[0], iter(kept[upto:inside])))
            out += [gap, MARK]
            at, used = m.end(), inside
        text, kept = "".join(out) + text[at:], blocks + kept[used:]
    return text, kept


def restore(text: str, blocks: Iterator[str]) -> str:
    """Puts the next blocks in the place of the marks."""
    return re.sub(MARK, lambda _: next(blocks), text) if MARK in text else text


def pieces(text: str, size: int, level: int = 0) -> Iterator[str]:
    """The text cut at the best separators, each piece at most ``size`` long."""
    if len(text) <= size:
        yield text
        return
    if level == len(SEPARATORS):
        for at in range(0, len(text), size):
            yield text[at : at + size]
        return
    sep = SEPARATORS[level]
    parts = text.split(sep)
    for k, part in enumerate(parts):
        yield from pieces(part + (sep if k < len(parts) - 1 else ""), size, level + 1)


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters (masked), each beginning with up to
    ``overlap`` characters of the last one's end; blank ones are left out."""
    masked, kept = mask(text)
    blocks = iter(kept)
    out: list[str] = []
    held: deque[tuple[int, str]] = deque()  # pieces with their blocks, and their masked lengths
    length = fresh = 0
    for part in pieces(masked, size):
        if held and length + len(part) > size:
            out.append("".join([x for _, x in held]))
            while held and (length > overlap or length + len(part) > size):
                length -= held.popleft()[0]
            fresh = 0
        held.append((len(part), restore(part, blocks)))
        length += len(part)
        fresh += 1
    if held and fresh:
        out.append("".join([x for _, x in held]))
    return [x for x in map(str.strip, out) if x]


def split(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, text) of ``split_text`` for rows (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, k, c) for i, t in zip(frame.doc_id, frame.text) if t for k, c in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(found, columns=["doc_id", "chunk_no", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, text string")


@udtf(returnType="chunk_no int, text string")
class SplitChunks:
    """``split`` as a table function for SQL: ``from docs, lateral split_chunks(docs.text, 1000, 200)``."""

    def eval(self, text: str, size: int = SIZE, overlap: int = OVERLAP):
        for k, piece in enumerate(split_text(text, size, overlap) if text else []):
            yield k, piece


def register_functions(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("split_chunks", SplitChunks)


def breadcrumb(title: Column, section: Column, path: Column, page: Column) -> Column:
    """``论文: title > section > path (第p页)`` with the parts that there are; '' without any."""
    some = lambda c: F.nullif(c, F.lit(""))
    line = F.concat_ws(" > ", F.concat(F.lit("论文: "), some(title)), some(section), some(path))
    paged = F.when((page > 0) & (line != ""), F.concat(F.lit(" (第"), page.cast("string"), F.lit("页)"))).otherwise("")
    return F.concat(line, paged)


def with_breadcrumb(chunks: DataFrame) -> DataFrame:
    """Chunks (source, section_title, heading_path, page, text) whose text begins with where it stands."""
    line = breadcrumb(F.col("source"), F.col("section_title"), F.col("heading_path"), F.col("page"))
    head = F.when(line != "", F.concat(F.lit("[上下文: "), line, F.lit("]\n\n"))).otherwise("")
    return chunks.withColumn("text", F.concat(head, "text"))


def _with_defaults(rows: DataFrame, **values) -> DataFrame:
    """Adds the columns that are missing; null counts as missing too."""
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in values.items()})


def structured(sections: DataFrame, tables: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, title, page, section_title, source, heading_path, text): a document's
    tables first, then its sections in order, each cut on its own and headed by where it stands.

    sections: doc_id, seq, title, content, and if known page, heading_path and source (the
    document's title); tables: doc_id, start, markdown, and if known caption, page,
    section_title and source.
    """
    none, zero = F.lit(""), F.lit(0)
    rows = _with_defaults(sections, title=none, content=none, page=zero, source=none)
    rows = _with_defaults(rows, heading_path=F.col("title"), section_title=F.col("title"))
    part = ["doc_id", "kind", "seq", "title", "page", "section_title", "source", "heading_path", "content"]
    rows = rows.withColumns({"kind": F.lit(1), "seq": F.col("seq").cast("long"), "page": F.col("page").cast("int")}).select(part)
    if tables is not None:
        of = _with_defaults(tables, caption=none, page=zero, section_title=none, source=none, markdown=none).filter(F.trim("markdown") != "")
        of = of.withColumns({
            "kind": F.lit(0), "seq": F.col("start").cast("long"), "page": F.col("page").cast("int"), "title": F.lit("表格"),
            "heading_path": F.concat(F.when(F.col("section_title") != "", F.concat("section_title", F.lit(" > "))).otherwise(""), F.lit("表格")),
            "content": F.concat(F.when(F.col("caption") != "", F.concat("caption", F.lit("\n"))).otherwise(""), "markdown"),
        })
        of = of.withColumn("section_title", F.when(F.col("section_title") != "", F.col("section_title")).otherwise(F.col("title")))
        rows = rows.unionByName(of.select(part))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*part[:-1], "k", "text"]
        for frame in frames:
            found = [(*r[:-1], k, c) for r in frame.itertuples(index=False, name=None) for k, c in enumerate(split_text(r[-1].strip(), size, overlap))]
            yield pd.DataFrame(found, columns=names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("k", T.IntegerType()), T.StructField("text", T.StringType())])
    cut = with_breadcrumb(rows.mapInPandas(run, schema))
    order = W.partitionBy("doc_id").orderBy("kind", "seq", "k")
    return cut.withColumn("chunk_no", F.row_number().over(order) - 1).select(
        "doc_id", "chunk_no", "title", "page", "section_title", "source", "heading_path", "text"
    )
