"""Approximate nearest neighbours by robust-pruned directed graphs (operator 8).

Different vectors are dealt out to shards by a hash. Each shard builds a graph:
greedy beam searches over what stands so far propose neighbours for a vector,
and pruning keeps a proposed neighbour only if no kept one is nearer to it, by
the factor ``ALPHA``, than the vector itself, so that the edges are diverse.
Every query then runs a beam search in every shard, and the shards' best are
merged. Inner products become distances by one further coordinate that gives
all of a shard's vectors the same norm.

Equal vectors form a class with one place in a graph; of a class only the
``k + 1`` smallest ids can be among k results, and these are joined back.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, take no part; vectors of each length are searched among their own, as there is
no inner product with others; with fewer candidates than k all
that are found are returned; ties go to the smaller id; rows with a null id take
no part, repeated rows of one id count once, and of different vectors under one id the
largest, compared component by component, counts; an empty table gives
an empty result; further columns are ignored.

Every query goes to every shard of its length, so the pairs of queries and shards grow with
both: one query is a row for each ``SHARD`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from foliospark.llm.common import Scratch

K, EVERY = 20, 20
#: Different lengths of vectors whose table is broadcast.
MAX_LENGTHS = 10_000
SHARD, DEGREE, ROOM, ALPHA, BEAM, WIDTH, BATCH = 16_384, 32, 48, 1.2, 96, 4, 256


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int):
    """The ``beam`` nearest found for each row of q: their places and distances, nearest first.

    The last row of x is a dummy at infinite distance, which pads the graph."""
    n, rows = len(x) - 1, np.arange(len(q))[:, None]
    qn = (q * q).sum(1)[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True

    def distances(ids: np.ndarray) -> np.ndarray:
        return norms[ids] + qn - 2 * np.einsum("bkd,bd->bk", x[ids], q)

    ids = np.full((len(q), beam), n)
    ids[:, : len(start)] = start
    seen[:, start] = True
    dist = distances(ids)
    done = ids == n
    while True:
        open_ = np.where(done, np.inf, dist)
        pick = np.argpartition(open_, WIDTH, axis=1)[:, :WIDTH]
        live = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        near = graph[np.where(live, np.take_along_axis(ids, pick, 1), n)].reshape(len(q), -1)
        near = np.sort(near, axis=1)
        fresh = ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows, near] = True
        near = np.where(fresh, near, n)
        ids = np.concatenate((ids, near), 1)
        dist = np.concatenate((dist, distances(near)), 1)
        done = np.concatenate((done, ~fresh), 1)
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        ids, dist, done = (np.take_along_axis(m, best, 1) for m in (ids, dist, done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def prune(x: np.ndarray, me: int, near: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours among the places ``near``."""
    near = np.unique(near[near != me])
    if not len(near):
        return near
    v = x[near]
    d = ((v - x[me]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    near, v, d = near[order], v[order], d[order]
    n2 = (v * v).sum(1)
    between = n2[:, None] + n2[None, :] - 2 * v @ v.T
    alive, kept = np.ones(len(near), bool), []
    while len(kept) < DEGREE:
        at = int(alive.argmax())
        if not alive[at]:
            break
        kept.append(at)
        alive &= ALPHA * ALPHA * between[at] > d
        alive[at] = False
    return near[kept]


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The graph over the rows of x (with its dummy), and where searches start."""
    n = len(x) - 1
    norms = np.append((x[:n] ** 2).sum(1), np.inf)
    graph = np.full((n + 1, ROOM), n)
    degree = np.zeros(n + 1, int)
    order = np.random.default_rng(7).permutation(n)
    start = order[: min(n, 8)]

    def put(i: int, near: np.ndarray) -> None:
        graph[i] = n
        graph[i, : len(near)] = near
        degree[i] = len(near)

    def join(batch: np.ndarray, proposed: list[np.ndarray]) -> None:
        back: dict[int, list[int]] = {}
        for i, near in zip(batch.tolist(), proposed):
            near = prune(x, i, np.concatenate((near[near != n], graph[i, : degree[i]])))
            put(i, near)
            for j in near.tolist():
                back.setdefault(j, []).append(i)
        for j, more in back.items():
            near = np.unique(np.concatenate((graph[j, : degree[j]], more)))
            put(j, near if len(near) <= ROOM else prune(x, j, near))

    first = order[: min(n, BATCH)]
    join(first, [first] * len(first))
    for again in (False, True):
        at = 0 if again else len(first)
        while at < n:
            batch = order[at : at + min(BATCH, n if again else at)]
            found, _ = beam_search(x, norms, graph, start, x[batch], BEAM)
            join(batch, list(found))
            at += len(batch)
    return graph, start


class Shard:
    """One shard's vectors and graph."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        # Scaled so that the largest norm is 1, which keeps distances finite.
        norms = np.sqrt((self.vectors**2).sum(1))
        self.scale = norms.max()
        flat = self.vectors / self.scale
        rest = np.sqrt(np.maximum(0, 1 - (flat**2).sum(1)))
        x = np.column_stack((flat, rest)).astype(np.float32)
        self.x = np.vstack((x, np.zeros((1, x.shape[1]), np.float32)))
        self.norms = np.append((x**2).sum(1), np.inf).astype(np.float32)
        self.graph, self.start = build(self.x)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, class id, inner product in double precision) of the k best found."""
        q = q.astype(np.float64)
        unit = q / np.sqrt((q**2).sum(1))[:, None]
        flat = np.column_stack((unit, np.zeros(len(q)))).astype(np.float32)
        found, _ = beam_search(self.x, self.norms, self.graph, self.start, flat, max(BEAM, k))
        row, col = np.nonzero(found < len(self.ids))
        place = found[row, col]
        score = np.add.reduce((q[row] * self.vectors[place]).T.copy(), axis=0)
        ids = self.ids[place]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], ids[rank < k], score[rank < k]


def _search(k: int):
    """Shards come as their own rows (query null) first, then all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, shard = [], [], None
        for batch in batches:
            at = batch.schema.get_field_index
            query = batch.column(at("query")).to_numpy(zero_copy_only=False).astype(bool)
            name = batch.column(at("id")).to_numpy(zero_copy_only=False)
            vec = batch.column(at("v"))
            v = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
            ids.append(name[~query])
            parts.append(v[~query])
            if not query.any():
                continue
            if shard is None:
                own = np.concatenate(ids)
                if not len(own):
                    continue
                shard = Shard(own, np.concatenate(parts))
                ids, parts = [], []
            asked, q = name[query], v[query]
            for i in range(0, len(q), BATCH):
                row, cls, score = shard.search(q[i : i + BATCH], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[i : i + BATCH][row]), pa.array(cls), pa.array(score)], ["query_id", "cls", "score"]
                )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is an array of doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(usable(vectors), "rows")
    classes = scratch.save(rows.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")), "classes")
    # A row for each length of vector: its number of shards and the first one's number.
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    first = F.sum("shards").over(W.orderBy("dim").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("shards")
    lengths = scratch.save(lengths.withColumn("from", first.cast("int")), "lengths")
    shards = lengths.agg(F.coalesce(F.sum("shards"), F.lit(1)).cast("int").alias("n")).first().n
    few = lengths.count() <= MAX_LENGTHS
    of = lambda df: df.withColumn("dim", F.size("v")).join(F.broadcast(lengths) if few else lengths.hint("merge"), "dim")
    own = of(classes).select(
        (F.col("from") + F.pmod(F.xxhash64("cls"), F.col("shards"))).cast("int").alias("shard"), F.lit(False).alias("query"),
        F.col("cls").alias("id"), "v",
    )
    asked = of(rows.filter(F.col("vec_id") % every == 0)).select(
        F.explode(F.sequence(F.col("from"), F.col("from") + F.col("shards") - 1)).alias("shard"), F.lit(True).alias("query"),
        F.col("vec_id").alias("id"), "v",
    )
    dealt = own.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("query", "id")
    found = dealt.select("query", "id", "v").mapInArrow(_search(k + 1), "query_id long, cls long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "cls")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    first = W.partitionBy("v").orderBy("vec_id")
    several = rows.withColumn("m", F.row_number().over(first)).filter(F.col("m") <= k + 1)
    members = several.withColumn("cls", F.min("vec_id").over(W.partitionBy("v"))).select("cls", "vec_id")
    joined = found.join(members.hint("merge"), "cls").filter("vec_id <> query_id")
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return joined.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
