"""Sharding by a hierarchical weighted hash tree (operator 7, native).

The shards hang under racks, the racks under regions. A row descends the tree:
at each level every child draws an exponential variate from a hash of the row's
id and the child's name, divided by the child's weight (the sum of the shards'
weights below it), and the smallest draw wins. A child's draw changes only with
its own weight, so a change of weights moves rows into or out of the subtrees
whose weights change and nowhere else.

The law that holds is ``key``: doc_id and the number of shards decide, in a tree whose
shape the ``base`` shards, which a cluster began with, have fixed. They fill regions in
order; each shard that is added later opens a region of its own, so that growth by one
shard, at any number, takes rows only into the new shard. (A shard that joined a region
would draw rows to that region, and there to its old shards too.)

Slots number a shard's rows from 0 without gaps. They are counted in parts by a
hash of doc_id, and the parts' sizes summed up, so that no task holds a shard.

Defined cases: a null doc_id is hashed as a null (such rows meet in one shard);
a null text has the size 8 and the checksum of the empty text; repeated rows go
to the same shard and get a slot each; of equal draws the child of the smaller number
wins; texts of any length are measured whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.llm.common import tasks

RACKS, SHARDS = 2, 4  # racks of a region, shards of a rack


def tree(n: int, racks: int = RACKS, shards: int = SHARDS, weights: list[float] | None = None, base: int | None = None):
    """Regions of racks of (shard, weight): the first ``base`` shards (all, if not given) fill
    regions in order, the others have one each."""
    weights = weights or [1.0] * n
    per, first = racks * shards, n if base is None else min(base, n)
    return [
        [
            [(s, float(weights[s])) for s in range(k, min(k + shards, first, r + per))]
            for k in range(r, min(r + per, first), shards)
        ]
        for r in range(0, first, per)
    ] + [[[(s, float(weights[s]))]] for s in range(first, n)]


def _draw(key: Column, level: int, parent: Column, child: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u in (0, 1) from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), parent, child), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def _pick(key: Column, level: int, parent: Column, children: Column) -> Column:
    """The child (a struct with ``id`` and ``weight``) of the smallest draw."""
    drawn = F.transform(
        children,
        lambda c: F.struct(
            _draw(key, level, parent, c["id"], c["weight"]).alias("draw"), c["id"].alias("id")
        ),
    )
    return F.array_min(drawn)["id"]


def _children(rows: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in rows])


def place(
    df: DataFrame, key: str, n: int, out: str = "shard", weights: list[float] | None = None, base: int | None = None,
) -> DataFrame:
    """Adds the shard of each row, among ``n``, as column ``out``; ``base`` as in ``tree``."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    regions = tree(n, weights=weights, base=base)
    total = lambda part: sum(w for _, w in part)
    top = _children([(r, sum(map(total, region))) for r, region in enumerate(regions)])
    racks = F.array(*[_children([(k, total(rack)) for k, rack in enumerate(region)]) for region in regions])
    leaves = F.array(*[F.array(*[_children(rack) for rack in region]) for region in regions])
    none = F.lit(0)
    return (
        df.withColumn("__region", _pick(F.col(key), 1, none, top))
        .withColumn("__rack", _pick(F.col(key), 2, F.col("__region"), racks[F.col("__region")]))
        .withColumn(
            out,
            _pick(
                F.col(key), 3, F.col("__region") * F.lit(1 << 16) + F.col("__rack"),
                leaves[F.col("__region")][F.col("__rack")],
            ).cast("int"),
        )
        .drop("__region", "__rack")
    )


def with_slots(df: DataFrame, shard: str, key: str, parts: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``slot``: numbers without gaps from 0 within each shard; ``more`` columns deal rows of one key to several parts."""
    df = df.withColumn("__part", F.pmod(F.xxhash64(F.lit(7), key, *more), F.lit(parts)).cast("int"))
    sizes = df.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = W.partitionBy(shard, "__part").orderBy(key, *more)
    return (
        df.join(starts.hint("shuffle_hash"), [shard, "__part"])
        .withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1)
        .drop("__part", "__start", "__n")
    )


def assign(docs: DataFrame, n: int = 24, base: int | None = None) -> DataFrame:
    """Size, checksum, shard, slot and the shard after growth by one, for each document.

    A cluster that has grown gives the number of shards that it began with as ``base``.
    """
    base = n if base is None else base
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(rows, "doc_id", n, base=base)
    slotted = with_slots(placed, "shard", "doc_id", tasks(docs.sparkSession), ("size", "text_crc32"))
    return place(slotted, "doc_id", n + 1, "grown_shard", base=base).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt out to 24 shards."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
