"""Continuous, repeatable ingest of parsed documents that arrive as JSON files.

Each trigger writes one version of the documents that it brings: their papers, chunks and
citation edges, below ``<table>/batch=<number>``. A trigger that runs again after a failure overwrites its own
folders alone, and the folder of papers is written last, so a document counts only if all of it is there. ``current``
gives each document as its latest version has it, with that version's chunks and edges; a document that
arrives again replaces itself. Nothing that is read is rewritten, so no failure can lose a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import embed as E
from foliospark.sources import parsed

PAPERS = "arxiv_id string, title string, abstract string, owner_id string, chunk_count int, ingest_status string, batch long"
EDGES = "citing string, cited string, cited_title string, context string, batch long"


def watch(
    spark: SparkSession, path: str, to: str, checkpoint: str, owner: str = "", lines: bool = False,
    make: Callable[[DataFrame], DataFrame] = E.hashed,
) -> StreamingQuery:
    """Ingests what has newly come to ``path`` into the tables below ``to``.

    A file holds one document, or one on each line if ``lines`` is set; a document's
    own id goes before the file's name. Of a document's copies in one trigger that of the last file counts.
    """
    rows = spark.readStream.schema(parsed.DOCUMENT).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    named = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    rows = rows.withColumns({"paper_id": F.coalesce(F.nullif("metadata.arxiv_id", F.lit("")), named), "__file": F.col("_metadata.file_path")})
    return rows.writeStream.foreachBatch(lambda df, n: _ingest(df, n, to, owner, make)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ingest(df: DataFrame, number: int, to: str, owner: str, make: Callable[[DataFrame], DataFrame]) -> None:
    put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{to}/{name}/batch={number}")
    latest = F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("__file"), F.desc(F.xxhash64("metadata", "sections"))))
    df = df.withColumn("__n", latest).filter("__n = 1").drop("__n", "__file")
    put(df, "documents")
    spark = df.sparkSession
    docs = spark.read.schema(df.schema).parquet(f"{to}/documents/batch={number}")
    own = docs.select(F.col("paper_id").alias("doc_id"), F.col("paper_id").alias("arxiv_id"), F.lit(owner).alias("owner_id"))
    chunks, edges, _ = E.ingest(parsed.flat_sections(docs), own, make)
    put(chunks, "chunks")
    put(edges, "edges")
    held = spark.read.schema(chunks.schema).parquet(f"{to}/chunks/batch={number}")
    papers = docs.select(
        F.col("paper_id").alias("arxiv_id"), "metadata.title", F.col("metadata.abstract").alias("abstract"), F.lit(owner).alias("owner_id"),
        F.lit(0).alias("chunk_count"), F.lit("ingested").alias("ingest_status"),
    )
    put(E.mark_ingested(papers, held), "papers")


def current(spark: SparkSession, to: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, chunks, edges) by the latest version of each document; pairs of edges are there once."""
    papers = spark.read.schema(PAPERS).parquet(f"{to}/papers")
    papers = papers.withColumn("__n", F.row_number().over(W.partitionBy("arxiv_id").orderBy(F.desc("batch")))).filter("__n = 1").drop("__n")
    live = papers.select("arxiv_id", "batch").hint("merge")
    chunks = spark.read.parquet(f"{to}/chunks").join(live, ["arxiv_id", "batch"], "left_semi").drop("batch")
    edges = spark.read.schema(EDGES).parquet(f"{to}/edges").withColumnRenamed("citing", "arxiv_id")
    edges = edges.join(live, ["arxiv_id", "batch"], "left_semi").withColumnRenamed("arxiv_id", "citing").drop("batch")
    return papers.drop("batch"), chunks, edges.dropDuplicates(["citing", "cited"])
