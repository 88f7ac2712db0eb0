"""Quality classifier by a modified Kneser-Ney language model (operator 2).

An interpolated modified Kneser-Ney model of n-grams of ``LENGTH`` bytes of UTF-8 is
trained on trusted documents (``labels.quality`` 1), but for one in ``LEFT_OUT``, from
which the limits come. Bytes tell all characters apart, and an n-gram is its own 48-bit
key, so the table grows with the trusted text and nothing is hashed or merged.

Each task gathers the different n-grams of its documents; counts are sharded by n-gram,
and each order's probabilities come from joins with the totals of their contexts and with
the order below. The table has the n-grams that were seen, of all orders, and what each
context leaves to the order below; a text that the table does not know, whether or not it was
there when the model was learned, backs off to shorter n-grams and last to equal bytes.

The cost of a byte is a sum over orders, so a text's is a sum over table rows: each context of
``m`` bytes adds its ``follow`` (what it costs to back off), and each seen n-gram of ``m`` bytes adds its
``gram`` (what being seen saves against that). Documents therefore meet the table in their own
tasks, in parts of about ``MOST`` rows, each of which is broadcast and adds its share to every
document's sum: a shuffle of the n-grams of all documents would move many times the text. A
larger table means more parts, not larger ones.

A document's figure is its perplexity by characters, drawn to its language's mean as if
``PRIOR`` further characters were average, so that short texts aren't judged by
a few letters (``plain_perplexity`` is without that). A document is rejected above its language's
threshold: the ``QUANTILE`` of the left out trusted documents of its language, which is the figure
of rank ceil(QUANTILE * n) exactly. A language with fewer than ``LEAST_DOCS`` of them uses the quantile of
all languages; if none is left out, those that were counted are used.

Defined cases: a null or empty text has no perplexity and is rejected; a null
language counts as the language ''; a doc_id with several labels is trusted if
all its labels that aren't null are 1; without trusted text every text that
isn't empty is kept; a figure equal to the limit is kept; repeated rows are judged row by
row; texts of any length are read whole, ``PIECE`` bytes of several or one text at a time; an
empty table gives an empty result; further columns are ignored or carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from foliospark.llm.common import Scratch, small_batches, tasks

QUANTILE, PRIOR, LEAST_DOCS = 0.99, 60, 30
#: Bytes of an n-gram; every LEFT_OUT-th trusted document is not counted; rows of a broadcast part; bytes of text handled at once.
LENGTH, LEFT_OUT, MOST, PIECE = 6, 5, 3_000_000, 400_000
#: Different n-grams that a task gathers before it passes them on.
GATHERED = 500_000
LEAST_DISCOUNT = 0.1  # so that nothing has probability 0
#: Trusted ids are broadcast up to this number (about 32 MB as a hash table); beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000
#: Rows of the tables by language that are broadcast; more are joined by a shuffle.
MAX_LANGUAGES = 100_000


def pieces(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, n-gram that ends at each byte, text of each byte, bytes of each text) of some texts at a time."""
    start, pad = 0, b"\0" * (LENGTH - 1)
    while start < len(raws):
        end, size = start + 1, len(raws[start])
        while end < len(raws) and size + len(raws[end]) <= PIECE:
            size += len(raws[end])
            end += 1
        lens = np.array([len(x) for x in raws[start:end]])
        line = np.frombuffer(pad + pad.join(raws[start:end]), np.uint8)
        inside = np.ones(len(line), bool)
        first = np.cumsum(lens + LENGTH - 1) - lens  # where each text begins
        for k in range(1, LENGTH):
            inside[first - k] = False
        code = np.zeros(max(0, len(line) - LENGTH + 1), np.int64)
        for k in range(LENGTH):
            code = code << 8 | line[k : k + len(code)]
        which = np.repeat(np.arange(len(lens)), lens)
        yield start, code[inside[LENGTH - 1 :]], which, lens
        start = end


def gather_ngrams(texts: DataFrame) -> DataFrame:
    """(code, c): how often each n-gram occurs in a column of texts."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([c for _, c in held]), len(code)).astype(np.int64)

    def rows(code: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + 100_000]), pa.array(c[i : i + 100_000])], ["code", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in small_batches(batches, 0):
            for _, codes, _, _ in pieces([x.as_py() or b"" for x in batch.column(0).cast(pa.binary())]):
                held.append(np.unique(codes, return_counts=True))
                size += len(held[-1][0])
                if size > GATHERED:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged(held))

    return texts.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def table(counts: DataFrame, scratch: Scratch) -> tuple[float, DataFrame]:
    """The cost of a byte that nothing is known of, and (order, code, gram, follow) of all that was seen.

    ``counts`` has the n-grams of the top order. Orders below count the different bytes before."""
    tables = {LENGTH: counts}
    for k in range(LENGTH - 1, 0, -1):
        below = F.col("code") % (1 << 8 * k)
        tables[k] = scratch.save(tables[k + 1].groupBy(below.alias("code")).agg(F.count("*").alias("c")), f"c{k}")
    base, lower, rows = math.log(256), None, None
    none = F.lit(0.0)
    for k in range(1, LENGTH + 1):
        n = {r["c"]: r["count"] for r in tables[k].filter("c <= 4").groupBy("c").count().collect()}  # at most four rows
        n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        steps = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
        d1, d2, d3 = (max(LEAST_DISCOUNT, min(i, max(0.0, i - (i + 1) * y * b / a)) if a else i * y) for i, a, b in steps)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = tables[k].groupBy(F.shiftright("code", 8).alias("ctx")).agg(
            F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("gamma")
        )
        ctx = scratch.save(ctx, f"ctx{k}")
        seen = tables[k].withColumn("ctx", F.shiftright("code", 8)).join(ctx.hint("merge"), "ctx")
        if k == 1:
            for only_one in ctx.collect():  # the empty context, if anything was seen
                base -= math.log(only_one["gamma"])
            seen = seen.withColumn("q", F.lit(1.0 / 256))
        else:
            seen = seen.withColumn("below", F.col("code") % (1 << 8 * (k - 1)))
            seen = seen.join(lower.select(F.col("code").alias("below"), F.col("p").alias("q")).hint("merge"), "below")
            follow = ctx.select(F.lit(k - 1).alias("order"), F.col("ctx").alias("code"), none.alias("gram"), (-F.log("gamma")).alias("follow"))
            rows = rows.unionByName(follow)
        back = F.col("gamma") * F.col("q")
        lower = scratch.save(seen.select("code", ((F.col("c") - discount) / F.col("total") + back).alias("p"), back.alias("back")), f"p{k}")
        grams = lower.select(F.lit(k).alias("order"), "code", F.log(F.col("back") / F.col("p")).alias("gram"), none.alias("follow"))
        rows = grams if rows is None else rows.unionByName(grams)
    whole = rows.groupBy("order", "code").agg(F.sum("gram").cast("float").alias("gram"), F.sum("follow").cast("float").alias("follow"))
    return base, scratch.save(whole, "table")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return (
        labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min("quality").alias("least")).filter("least = 1").select("doc_id")
    )


def left_out(id: str = "doc_id"):
    """Whether a trusted document is for the limits and not for the counts."""
    return F.pmod(F.xxhash64(id), F.lit(LEFT_OUT)) == 0


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these ids; the ids are broadcast only if few."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


@dataclass
class Model:
    """The cost of an unknown byte, and parts of the table: keys (bytes from the last one on, then the order), gram, follow."""

    base: float
    parts: list[Broadcast]


def _last_first(codes: np.ndarray) -> np.ndarray:
    """Codes with the last byte on top, so that shorter n-grams are prefixes and sorted codes look up sorted keys."""
    return codes.astype(np.int64).byteswap().view(np.uint64)


def _costs(part: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    """For each of the sorted codes the sum over orders of these columns of its n-grams' rows."""
    keys, out = part[0], np.zeros(len(codes))
    for m in range(1, LENGTH + 1) if len(keys) else ():
        asked = codes & np.uint64((1 << 64) - (1 << 64 - 8 * m)) | np.uint64(m)
        new = np.concatenate(([True], asked[1:] != asked[:-1]))[: len(asked)]
        some = asked[new]
        to = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        value = np.where(keys[to] == some, sum(part[c][to] for c in columns), np.float32(0))
        out += value[np.cumsum(new) - 1]
    return out


def with_entropy(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``nll``, the negative log probability of each text, and ``n_symbols``, its characters."""
    names = ("nll", "n_symbols")
    kept = docs.select([c for c in docs.columns if c.lower() not in names])
    base = F.coalesce(F.octet_length(text) * F.lit(model.base), F.lit(0.0))
    out = kept.withColumns({"nll": base, "n_symbols": F.coalesce(F.length(text), F.lit(0)).cast("long")})

    def adding(part: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start_costs = None
            for batch in small_batches(batches, text):
                if start_costs is None:  # what the contexts before a text's first byte leave to the order below
                    start_costs = _costs(part.value, np.arange(1, dtype=np.uint64), (2,))[0]
                raws = [x.as_py() or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary())]
                total = np.array(batch.column(batch.num_columns - 2), np.float64)
                for start, codes, which, lens in pieces(raws):
                    size, ends = len(lens), np.cumsum(lens)[lens > 0] - 1
                    last, back = np.unique(_last_first(codes[ends]), return_inverse=True)
                    code, at = np.unique(_last_first(codes), return_inverse=True)
                    del codes
                    cost = _costs(part.value, code, (1, 2))[at]
                    cost[ends] -= _costs(part.value, last, (2,))[back]  # nothing follows a text's last byte
                    total[start : start + size] += np.bincount(which, cost, size) + np.where(lens > 0, start_costs, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(total, pa.float64()), batch.column(batch.num_columns - 1)], batch.schema.names)

        return run

    schema = T.StructType([*kept.schema.fields, T.StructField("nll", T.DoubleType()), T.StructField("n_symbols", T.LongType())])
    for part in model.parts:
        out = out.mapInArrow(adding(part), schema)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the trusted documents that are counted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    texts = only(docs.select("doc_id", "text"), trusted_ids(labels).filter(~left_out())).select("text")
    base, rows = table(scratch.save(gather_ngrams(texts), "counts"), scratch)
    n = max(1, -(-rows.count() // MOST))
    parts = []
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("order", "code"), F.lit(n)) == i).toArrow()  # about MOST rows
        keys = _last_first(part.column("code").to_numpy()) | part.column("order").to_numpy().astype(np.uint64)
        by = np.argsort(keys)
        parts.append(spark.sparkContext.broadcast((keys[by], part.column("gram").to_numpy()[by], part.column("follow").to_numpy()[by])))
    scratch.drop("")
    return Model(base, parts)


def figure(mean: str = "mean_h"):
    """Perplexity, drawn to the language's mean by PRIOR characters; null without text."""
    h = (F.col("nll") + PRIOR * F.col(mean)) / (F.col("n_symbols") + PRIOR)
    return F.when(F.col("n_symbols") > 0, F.exp(h))


def _limits(figured: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(lang, mean_h, threshold): the figure of rank ceil(QUANTILE * n) of each language, from counts of sorted ranges,
    so that no task holds a language."""
    ranged = figured.repartitionByRange(tasks(figured.sparkSession), "lang", "x").withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, f"ranged-{name}")
    by = Window.partitionBy("lang")
    counts = ranged.groupBy("lang", "mean_h", "part").agg(F.count("*").alias("n"))  # a row for each language and range
    counts = counts.withColumn("upto", F.sum("n").over(by.orderBy("part"))).withColumn("all", F.sum("n").over(by))
    rank = F.ceil(F.lit(QUANTILE) * F.col("all"))
    here = counts.withColumn("rank", rank - F.col("upto") + F.col("n")).filter("rank between 1 and n").select("lang", "part", "rank")
    here = scratch.save(here.select(F.col("lang").alias("__lang"), F.col("part").alias("__part"), "rank"), f"here-{name}")
    inside = ranged.join(here.hint("merge"), F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("part") == F.col("__part")))
    row = F.row_number().over(Window.partitionBy("lang", "part").orderBy("x"))
    return inside.withColumn("row", row).filter("row = rank").select("lang", "mean_h", F.col("x").alias("threshold"))


def thresholds(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """(lang, mean_h, threshold); lang null stands for all languages together."""
    scratch = Scratch(docs.sparkSession, "quality")
    ids = trusted_ids(labels)
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").filter("text <> ''")
    trusted = only(texts, ids.filter(left_out()))
    if trusted.isEmpty():
        trusted = only(texts, ids)
    rows = scratch.save(with_entropy(trusted.drop("doc_id"), model).drop("text"), "trusted")
    out = None
    for by in ("lang", None):
        key = F.col("lang") if by else F.lit(None).cast("string")
        keyed = rows.withColumn("lang", key)
        exact = F.sum(F.col("nll").cast("decimal(28,8)")).cast("double")  # the same in any order
        means = keyed.groupBy("lang").agg((exact / F.sum("n_symbols")).alias("mean_h"), F.count("*").alias("n"))
        means = scratch.save(means if not by else means.filter(F.col("n") >= LEAST_DOCS), f"means{by}")
        same = keyed["lang"].eqNullSafe(means["lang"])
        # A row for each language (or one): broadcast if few, so that no language goes to one task.
        few = means.count() <= MAX_LANGUAGES
        figured = keyed.join(F.broadcast(means) if few else means.hint("merge"), same).select(
            means["lang"], "mean_h", figure().alias("x")
        )
        part = _limits(figured, scratch, str(by))
        out = part if out is None else out.unionByName(part)
    result = Scratch(docs.sparkSession, "quality").save(out, "thresholds")
    scratch.drop("")
    return result


def judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``perplexity``, ``plain_perplexity``, ``threshold`` and ``kept`` to rows with nll and n_symbols.

    The thresholds have a row for each language; they are broadcast if at most
    ``MAX_LANGUAGES``, else joined by a shuffle.
    """
    spare = limits.filter("lang is null").select(
        F.col("mean_h").alias("__mean"), F.col("threshold").alias("__threshold")
    )
    own = limits.filter("lang is not null").select(
        F.col("lang").alias("__lang"), F.col("mean_h").alias("__own_mean"), F.col("threshold").alias("__own_threshold")
    )
    few = own.count() <= MAX_LANGUAGES
    joined = scored.withColumn("__key", F.coalesce("lang", F.lit("")))
    joined = joined.join(
        F.broadcast(own) if few else own.hint("merge"), F.col("__key") == F.col("__lang"), "left"
    ).join(F.broadcast(spare), F.lit(True), "left")  # one row at most
    return (
        joined.withColumn("mean_h", F.coalesce("__own_mean", "__mean", F.lit(0.0)))
        .withColumn("perplexity", figure())
        .withColumn("plain_perplexity", F.when(F.col("n_symbols") > 0, F.exp(F.col("nll") / F.col("n_symbols"))))
        .withColumn("threshold", F.coalesce("__own_threshold", "__threshold"))
        .withColumn("kept", F.coalesce(F.col("n_symbols") > 0, F.lit(False))
                    & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
        .drop("__key", "__lang", "__own_mean", "__own_threshold", "__mean", "__threshold", "mean_h")
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with nll, n_symbols, perplexity, plain_perplexity, threshold and kept."""
    model = learn(docs, labels)
    return judged(with_entropy(docs, model), thresholds(docs, labels, model))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Perplexity of every document and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).drop("text", "nll")
