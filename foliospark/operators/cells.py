"""Vector search by cells: exact, and without comparing every query with every row where cells allow it.

Cells come from k-means on a bounded sample; centres and radii are tables, a row for each cell.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators import blocks, retrieval as R
from foliospark.sources.scratch import saved

#: Rows that cells are fitted on, and the most cells: so many centres are broadcast.
SAMPLE, MOST_CELLS = 20_000, 1_024


def cells_for(rows: int) -> int:
    """As many cells as there are rows in each, up to ``MOST_CELLS``."""
    return max(1, min(MOST_CELLS, math.isqrt(rows)))


def fit_cells(vectors: DataFrame, k: int = 16, sample: int = SAMPLE, seed: int = 1) -> KMeansModel:
    """Cells of a search, fitted on a sample of at most ``sample`` rows."""
    rows = vectors.orderBy(F.xxhash64("id")).limit(sample)
    return KMeans(k=k, seed=seed, featuresCol="v", maxIter=10).fit(rows.select(array_to_vector(R.normalised(F.col("embedding"))).alias("v")))


def _gap(a: Column, b: Column) -> Column:
    """The squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cell_search(vectors: DataFrame, queries: DataFrame, model: KMeansModel, probes: int = 4, top: int = 20) -> DataFrame:
    """(query_id, id, distance, rank): the nearest rows, first from each query's ``probes`` nearest
    cells, then from every other cell that may hold a nearer row than the last one found.

    On unit vectors a cosine distance is half the squared distance, and no row of a cell is nearer
    than its centre less the cell's radius; a zero vector is at distance 1, beyond that bound too.
    Rows and queries without a vector are left out.
    """
    vectors, queries = vectors.filter("embedding is not null"), queries.filter("query_vector is not null")
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centers = F.broadcast(vectors.sparkSession.createDataFrame(found, "cell int, center array<double>"))  # at most MOST_CELLS rows
    placed = model.transform(vectors.select("id", "embedding", array_to_vector(R.normalised(F.col("embedding"))).alias("v")))
    placed = saved(placed.select("id", "embedding", vector_to_array("v").alias("unit"), F.col("prediction").alias("cell")), "cells")
    reach = F.sqrt(_gap(F.col("center"), F.col("unit")))
    radii = placed.join(centers, "cell").groupBy("cell", "center").agg(F.max(reach).alias("radius"))
    every = radii.agg(F.collect_list(F.struct("cell", "center", "radius")).alias("cells"))  # one row, of at most MOST_CELLS cells
    unit = queries.select("query_id", "query_vector", R.normalised(F.col("query_vector")).alias("unit"))
    order = [F.asc("distance"), F.asc("id")]

    def by_gap(asked: DataFrame) -> DataFrame:
        """All cells, the nearest first, as one array for each query; no row is made or written for a cell that isn't looked into."""
        far = F.transform("cells", lambda c: F.struct(_gap(c["center"], F.col("unit")).alias("d"), c["cell"].alias("cell"), c["radius"].alias("radius")))
        return asked.crossJoin(F.broadcast(every)).withColumn("far", F.array_sort(far)).drop("cells", "unit")

    def search(asked: DataFrame, which: Column) -> DataFrame:
        cells = asked.select("query_id", "query_vector", F.explode(F.transform(which, lambda c: c["cell"])).alias("cell"))
        cells = saved(cells, "asked_cells")
        pairs = blocks.nearest(placed.select("cell", "id", "embedding"), cells, top, on=("cell",), groups=len(found), queries=R.MAX_QUERIES)
        return R.ranked(pairs, order, top).drop("rank")

    first = saved(search(by_gap(unit), F.slice("far", 1, probes)), "nearest_cells")
    last = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
    again = by_gap(unit.join(last.hint("merge"), "query_id", "left"))
    least = lambda c: F.pow(F.greatest(F.sqrt(c["d"]) - c["radius"], F.lit(0.0)), 2) / 2
    few = F.coalesce(F.col("n") < top, F.lit(True))
    # distances have six places
    others = F.filter(F.slice("far", probes + 1, F.greatest(F.size("far") - probes, F.lit(0))), lambda c: few | (least(c) <= F.col("last") + 1e-5))
    return R.ranked(first.unionByName(search(again, others)), order, top)
