"""A training-data pipeline of five stages, each applying one operator to what the last one kept.

The rows of a filtering stage that are rejected go; the others keep the columns
of ``documents`` as they are. The last stage returns token ids and digests.

The near-dedup stage removes rows by doc_id and text. Rows without doc_id stay there; rows
that repeat one doc_id with one text count as one document; of two texts under one doc_id
only the one that is a copy of another document goes. Null and empty texts are rejected by
the first stage; texts of any length are read whole; empty tables give an empty result, and
without labels or benchmark the stages that need them keep every text that isn't empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.llm import bpe, decontam, neardup, quality as lm, toxicity as mil
from foliospark.llm.common import Scratch, bound_batches

#: Names that the operators add to rows; a table's own columns of these names are set aside.
RESERVED = {"nll", "n_symbols", "perplexity", "plain_perplexity", "threshold", "kept", "mean_h", "score", "offending",
            "n_words", "n_hit", "n_items", "item_ids", "spans", "hit_words"}
#: Up to so many pairs of numbers (about 32 MB as a hash table) are broadcast to remove rows; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000


def _keeping_columns(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a filtering step and gives back the columns of ``docs``."""
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in RESERVED}
    out = step(docs.withColumnsRenamed(aside))
    return out.select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the language model finds ordinary for their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = lm.learn(docs, labels)
    limits = lm.thresholds(docs, labels, model)
    return _keeping_columns(docs, lambda d: lm.judged(lm.with_entropy(d, model), limits).filter("kept"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = mil.train(docs, labels)
    return _keeping_columns(docs, lambda d: mil.with_scores(d, model).filter(F.col("score") < mil.TOXIC))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    hashed = F.xxhash64("text").alias("text_hash")
    found = neardup.near_duplicates(docs.select("doc_id", "text", hashed), extra=("text_hash",))
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_hash").distinct()
    few = gone.count() <= MAX_BROADCAST_IDS
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash"))
    same = (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), same, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _keeping_columns(
        docs, lambda d: decontam.with_hits(d, benchmark).filter(f"not ({decontam.CONTAMINATED})")
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.with_tokens(
        docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, ids=True, digests=True
    )
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


def _job(stage: Callable) -> Callable:
    """A stage with the session's bound on Arrow batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _job(quality)),
    ("toxicity", _job(toxicity)),
    ("near_dedup", _job(near_dedup)),
    ("decontamination", _job(decontamination)),
    ("tokens", _job(tokens)),
]

#: SQL can't express the stages; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
