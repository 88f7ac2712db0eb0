"""The pipeline against its operators' verdicts, row by row."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import decontam, neardup, quality, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with null and repeated rows and columns of clashing names."""
    to = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", to)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.lit(None).cast("string")})
    copy = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 200_000)
    # very long texts, and one doc_id with two texts, of which one is a copy
    long = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 300_000, "text": F.repeat(F.concat("text", F.lit(" ")), 300)})
    twice = docs.limit(2).withColumn("doc_id", F.lit(400_000).cast("long"))
    all_ = docs.unionByName(odd).unionByName(copy).unionByName(long).unionByName(twice).withColumns({"score": F.lit(2.5), "kept": F.lit("x")})
    all_.write.parquet(os.path.join(to, "documents.parquet"))
    return str(to)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, folder)
        assert after.columns == docs.columns
        if name == "quality":
            want = ids(quality.classify(at.drop("kept"), labels).filter("kept"))
        elif name == "toxicity":
            want = ids(toxicity.with_scores(at, toxicity.train(at, labels)).filter(F.col("score") < toxicity.TOXIC))
        elif name == "near_dedup":
            want = ids(neardup.near_duplicates(at).filter("kept"))
        else:
            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            want = ids(decontam.with_hits(at, bench).filter(f"not ({decontam.CONTAMINATED})"))
        assert ids(after) == want
        assert after.filter("score = 2.5 and kept = 'x'").count() == len(want)
        at = after
    out = corpus_pipeline.run(spark, folder)
    assert at.count() < docs.count()
    assert ids(out) == ids(at) and out.filter("n_tokens = size(token_ids)").count() == at.count()


def test_empty(spark, folder, tmp_path):
    shutil.copytree(folder, tmp_path, dirs_exist_ok=True)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_id_with_two_texts(spark):
    """Of two texts under one id only the copy goes; of equal groups the smallest id stays; long texts are compared whole."""
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    long = words(60_000, 7)
    rows = [(1, words(50, 3)), (5, words(50, 3)), (5, words(50, 11)), (2, long), (9, long + " end"), (8, long[: len(long) // 2]), (None, words(50, 3)), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, corpus_pipeline.near_dedup(spark, docs, "").collect()))
    want = [rows[0], rows[2], rows[3], rows[5], rows[6], rows[7], rows[8]]
    assert got == sorted(map(str, spark.createDataFrame(want, docs.schema).collect()))
