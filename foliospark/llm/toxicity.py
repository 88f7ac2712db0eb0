"""Toxicity by multiple-instance learning (operator 1).

A document is a bag of sentences. A sentence's probability is a logistic
function of its words and word beginnings; the document's is their noisy-or,
1 - prod(1 - p). Only document labels are needed to train it, and a sentence's
own probability then says where the offence is.

Training uses a bounded sample of the labelled rows of the training fold: at
most ``MAX_TOXIC`` and ``MAX_CLEAN`` documents, taken by a hash of doc_id, each id once. The
whole texts of these are read in parallel; the fitting task gets their feature keys only, a
bounded number of documents of them. Scores come from the text alone.

Defined cases: a null or empty text has no sentence and scores 0; without rows
of both labels all scores are 0; labels that are null are left out, and a
doc_id with several labels counts as toxic if one says so; of several texts of one
doc_id the largest is learnt from; repeated rows are scored row by row; equal scores are
equal verdicts, a score of exactly 0.7 is toxic; texts of any length are read whole; an empty table gives an empty result; further columns are
ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import alnum_spans, small_batches, hash_spans, mix
from foliospark.llm.decontam import char_offsets

MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: A feature counts if this many sampled documents have it, and if its share of
#: toxic documents is beyond what the best of that many chance features would show.
LEAST_DOCS = 3
STEPS, RATE, DECAY, START = 150, 0.15, 1e-4, -6.0
#: Scores from here on are toxic.
TOXIC = 0.7
PREFIXES = (4, 5)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature keys (a row for each word, a column for each kind), the number of
    each word's sentence, and the sentences' byte spans. Only sentences with
    words count."""
    low, starts, ends = alnum_spans(raw)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.uint64), none, none, none
    stops = np.cumsum(_ENDS[np.frombuffer(raw, np.uint8)])[starts]
    _, first, sentence = np.unique(stops, return_index=True, return_inverse=True)
    last = np.append(first[1:], len(starts)) - 1
    keys = [hash_spans(low, starts, ends)]
    for k in PREFIXES:
        keys.append(mix(hash_spans(low, starts, np.minimum(ends, starts + k)) + np.uint64(k)))
    return np.stack(keys, 1), sentence, starts[first], ends[last]


def telling(docs: np.ndarray, bad: np.ndarray, rate: float) -> np.ndarray:
    """Which features' toxic share differs from ``rate`` by a likelihood-ratio test."""
    def part(k, n, q):
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(n * q, 1e-9))

    g = 2 * (part(bad, docs, rate) + part(docs - bad, docs, 1 - rate))
    enough = docs >= LEAST_DOCS
    return enough & (g >= 2 * np.log(max(2, enough.sum())))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature keys (sorted), their weights, and the bias, from each document's feature keys by word and sentence numbers."""
    nothing = np.zeros(0, np.uint64), np.zeros(0), -40.0
    seen = [np.unique(k) for k, _ in bags]
    y = np.array(toxic, float)
    if not seen or not y.any() or y.all():
        return nothing
    known, at, docs = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
    bad = np.bincount(at, np.repeat(y, [len(x) for x in seen]), len(known))
    known = known[telling(docs, bad, y.mean())]
    if not len(known):
        return nothing
    index, words, sizes, base = [], [], [], 0
    for keys, sentence in bags:
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        row, kind = np.nonzero(known[at] == keys)
        index.append(at[row, kind].astype(np.int32))
        words.append((sentence[row] + base).astype(np.int32))
        sizes.append(int(sentence[-1]) + 1 if len(sentence) else 0)
        base += sizes[-1]
    index, where = np.concatenate(index), np.concatenate(words)
    owner = np.repeat(np.arange(len(bags)), sizes)
    w, b = np.zeros(len(known)), START
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(where, w[index], base)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        doc = -np.expm1(clean)
        pull = np.where(y > 0, -np.exp(clean) / np.maximum(doc, 1e-9), 1.0)
        g = p * pull[owner] / len(bags)
        grad = np.append(np.bincount(index, g[where], len(known)) + DECAY * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, b = w - move[:-1], b - 0.3 * move[-1]
    return known, w, b


def training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from a bounded sample of labelled rows of the training fold."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    part = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # At most MAX_TOXIC + MAX_CLEAN rows of two numbers, so the broadcast is bounded.
    sample = F.broadcast(part(1, MAX_TOXIC).unionByName(part(0, MAX_CLEAN)))
    # One text for each id: repeated rows are merged, and of different texts the largest counts.
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys, sentences = [], []
            for raw in batch.column(2).cast(pa.binary()):
                key, sentence, _, _ = features(raw.as_py() or b"")
                # Equal words of one sentence stay: each adds to its sentence.
                keys.append(key.astype("<u8").tobytes())
                sentences.append(sentence.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sentences, pa.binary())],
                ["doc_id", "toxic", "keys", "sentences"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, toxic = [], []
        for batch in batches:
            for key, sentence in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                bags.append((np.frombuffer(key, "<u8").reshape(-1, 1 + len(PREFIXES)), np.frombuffer(sentence, "<i4").astype(np.int64)))
            toxic += batch.column(1).to_pylist()
        keys, weights, bias = fit(bags, toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys, np.uint64(0)).view(np.int64)), pa.array(np.append(weights, bias))],
            ["key", "weight"],
        )

    bags = rows.mapInArrow(read, "doc_id long, toxic int, keys binary, sentences binary")
    found = bags.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "key long, weight double").collect()
    if not found:  # no rows at all
        return np.zeros(0, np.uint64), np.zeros(0), -40.0
    keys = np.array([r.key for r in found[:-1]], np.int64).view(np.uint64)
    return keys, np.array([r.weight for r in found[:-1]]), found[-1].weight


class Scorer:
    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        self.keys, self.weights, self.bias = model
        self.maybe = np.zeros(1 << 20, bool)  # which low bits any key has
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def sentences(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities and byte spans of the sentences."""
        keys, sentence, starts, ends = features(raw)
        z = np.full(len(starts), self.bias)
        row, kind = np.nonzero(self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(row) and len(self.keys):
            want = keys[row, kind]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            z += np.bincount(sentence[row[hit]], self.weights[at[hit]], len(starts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), starts, ends


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType()),
]))
RESULT = [T.StructField("score", T.DoubleType()), T.StructField("offending", SPANS)]


def with_scores(docs: DataFrame, model, text: str = "text", offending: float = 0.5) -> DataFrame:
    """Adds ``score`` and ``offending``: the character spans and probabilities of
    sentences from that probability on. Columns of these names are replaced."""
    names = {f.name for f in RESULT}
    kept = docs.select([c for c in docs.columns if c.lower() not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded with the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small_batches(batches, text):
            scores, spans = [], []
            for raw in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
                raw = raw.as_py() or b""
                p, starts, ends = scorer.sentences(raw)
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                k = np.flatnonzero(p >= offending)
                if len(k):
                    a, b = char_offsets(raw, starts[k]), char_offsets(raw, ends[k])
                    spans.append([{"start": int(x), "end": int(y), "p": float(q)} for x, y, q in zip(a, b, p[k])])
                else:
                    spans.append([])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)],
                [*batch.schema.names, *(f.name for f in RESULT)],
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *RESULT]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return with_scores(docs, model).select(
        "doc_id",
        F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        "offending",
    )
