"""Embedding jobs, reuse of stored vectors, recall of searches, and corpus ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions import text as T
from foliospark.operators import chunks as C, citations as X, library as L
from foliospark.sources.scratch import saved

DIM, BATCH = 64, 32


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], dim: int, text: str = "text") -> DataFrame:
    """Adds ``embedding`` by a user's function of up to BATCH texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            parts = [np.asarray(model(texts[i : i + BATCH]), np.float32) for i in range(0, len(texts), BATCH)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
            yield frame.assign(embedding=list(vectors))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, embedding array<float>")


def hashed(rows: DataFrame, dim: int = DIM, text: str = "text") -> DataFrame:
    """Adds ``embedding``: hashed token counts of length 1, the default without a model."""
    made = HashingTF(numFeatures=dim, inputCol="__t", outputCol="__f").transform(rows.withColumn("__t", T.tokens(F.col(text))))
    unit = Normalizer(inputCol="__f", outputCol="__n").transform(made)
    return unit.withColumn("embedding", vector_to_array("__n", "float32")).drop("__t", "__f", "__n")


def reused(rows: DataFrame, stored: DataFrame, provider: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, newly made vectors): each different text is embedded once, and
    only if ``stored`` (key, embedding) lacks it."""
    keyed = rows.withColumn("key", T.content_key(F.lit(provider), F.col("text")))
    missing = keyed.groupBy("key").agg(F.min("text").alias("text")).join(stored.select("key").hint("merge"), "key", "left_anti")
    new = make(missing).select("key", "embedding")
    return keyed.join(stored.select("key", "embedding").unionByName(new).hint("merge"), "key"), new


def write_chunks(chunks: DataFrame, path: str, dim: int) -> DataFrame:
    """Writes chunks by owner; gives back those whose vector has another length, which aren't written."""
    good = (F.size("embedding") == dim) & F.col("chunk_id").isNotNull()
    chunks.filter(good).write.partitionBy("owner_id").parquet(path)
    return chunks.filter(~F.coalesce(good, F.lit(False)))


def replace_owners(chunks: DataFrame, path: str, dim: int) -> DataFrame:
    """As ``write_chunks``, but what ``path`` has of these owners goes; other owners' files stay as they are."""
    good = (F.size("embedding") == dim) & F.col("chunk_id").isNotNull()
    put = chunks.filter(good).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    put.partitionBy("owner_id").parquet(path)
    return chunks.filter(~F.coalesce(good, F.lit(False)))


def reset_owner(spark: SparkSession, path: str, owner: str) -> int:
    """Drops an owner's folder of a chunk table; gives the number of rows that went."""
    n = spark.read.parquet(path).filter(F.col("owner_id") == owner).count()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/owner_id={owner}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact hits that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def ingest(sections: DataFrame, papers: DataFrame, make: Callable[[DataFrame], DataFrame] = hashed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with vectors, citation edges, one summary row) of parsed documents.

    sections: doc_id, seq, title, content; papers: doc_id, arxiv_id, owner_id.
    """
    cut = C.structured(sections).join(papers.select("doc_id", "arxiv_id", "owner_id").hint("merge"), "doc_id")
    chunks = make(cut.withColumn("chunk_id", F.concat_ws("_", "arxiv_id", F.col("chunk_no").cast("string"))))
    edges = X.edges(X.reference_sections(sections), papers.select("doc_id", "arxiv_id"))
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("arxiv_id").alias("papers"))
    summary = counts.crossJoin(F.broadcast(edges.agg(F.count("*").alias("citations"))))
    return chunks, edges, summary


def ingest_reusing(
    sections: DataFrame, papers: DataFrame, stored: DataFrame, provider: str = "hashed", make: Callable[[DataFrame], DataFrame] = hashed
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks with vectors, citation edges, papers with status and counts, newly made vectors): as ``ingest``, but
    texts whose vectors are ``stored`` (key, embedding) are not embedded again, and equal texts once."""
    made: list[DataFrame] = []

    def once(cut: DataFrame) -> DataFrame:
        rows, new = reused(saved(cut, "cut"), stored, provider, lambda missing: saved(make(missing), "vectors"))
        made.append(new)
        return saved(rows.drop("key"), "chunks")

    chunks, edges, _ = ingest(sections, papers, once)
    return chunks, edges, mark_ingested(papers.withColumns({"chunk_count": F.lit(0), "ingest_status": F.lit("pending")}), chunks), made[0]


def ingest_texts(texts: DataFrame, owner: str | Column = "", title: str = "Untitled", make: Callable[[DataFrame], DataFrame] = hashed) -> DataFrame:
    """Chunks with vectors of raw texts (doc_id, text), with default metadata."""
    cut = C.split(texts).withColumns({"title": F.lit(title), "owner_id": F.lit(owner), "source": F.lit("text")})
    return make(cut.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))))


def mark_ingested(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Papers with the status and chunk count of what was ingested."""
    n = chunks.groupBy("arxiv_id").agg(F.count("*").cast("int").alias("chunk_count"), F.lit("ingested").alias("ingest_status"))
    return L.update(papers, n, "arxiv_id", ["chunk_count", "ingest_status"])
