"""Best pairs of rows and queries by blocks: parts of the rows meet parts of the queries, one matrix product for each two parts.

A task holds one part of each side and a few million products, whatever the tables' sizes; what it passes on is each query's best
rows of its part. Products choose the candidates with a margin; figures, rounding and ties of these are those of the column
expressions in ``retrieval``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows and queries of a block, the least rows for which another task pays, products held at once.
ROWS, QUERIES, LEAST_ROWS, HELD = 32_768, 4_096, 2_048, 1 << 21
#: Beyond the last candidate's product: figures are compared with six places.
MARGIN = 2e-6


def rounded(x: np.ndarray) -> np.ndarray:
    """As ``F.round(x, 6)`` of numbers from 0: halves of the shortest decimal form go up."""
    scaled = x * 1e6
    low = np.floor(scaled)
    out = (low + (scaled - low >= 0.5)) / 1e6
    for k in np.flatnonzero(np.abs(scaled - low - 0.5) < 1e-6 + 1e-15 * scaled):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def places(ids: pa.ChunkedArray) -> np.ndarray:
    """Each id's place in their order, nulls first."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def firsts(query: np.ndarray, top: int, *order: np.ndarray) -> np.ndarray:
    """Which rows are among the first ``top`` of their query, by ``order``."""
    sort = np.lexsort((*reversed(order), query))
    q = query[sort]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    at = np.arange(len(q))
    return sort[at - np.maximum.accumulate(np.where(new, at, 0)) < top]


def _by_length(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of vector; a null component is NaN."""
    arrays = column.combine_chunks()
    lengths = pc.list_value_length(arrays).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        flat = arrays.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        out.append((own, flat.astype(np.float64).reshape(len(own), int(n))))
    return out


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Dot products of rows i of a and k of b, summed from the first component on."""
    out = np.zeros(len(i))
    for c in range(a.shape[1]):
        out += a[i, c] * b[k, c]
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    own = np.arange(len(a))
    return np.sqrt(_dots(a, a, own, own))


def _cosines(x, q, xn, qn, i, k) -> np.ndarray:
    """As ``retrieval.cosine_distance``, where a figure that isn't a number is the cosine 1."""
    n = xn[i] * qn[k]
    c = (_dots(x, q, i, k) if x.shape[1] == q.shape[1] else np.full(len(i), np.nan)) / n
    return np.where(n == 0, 1.0, 1 - np.clip(np.where(np.isnan(c), 1.0, c), -1.0, 1.0))


def _gaps(x, q, i, k) -> np.ndarray:
    """Half the squared distances of unit vectors; NaN for opposite ones."""
    out = np.zeros(len(i))
    for c in range(x.shape[1]):
        out += (x[i, c] - q[k, c]) ** 2
    d = np.sqrt(out)
    return np.where(d < 2.0, d * d / 2, np.nan)


def _buckets(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.combine_chunks().flatten()).reshape(len(column), -1)


def _met(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each query of g shares a bucket with each row of h."""
    out = np.zeros((len(g), len(h)), bool)
    for t in range(h.shape[1]):
        out |= g[:, t][:, None] == h[:, t][None, :]
    return out


def _candidates(c: np.ndarray, top: int) -> np.ndarray:
    """Pairs that may be among the ``top`` of a row of products."""
    n = c.shape[1]
    return c >= np.partition(c, n - top, axis=1)[:, n - top, None] - MARGIN if n > top else np.ones(c.shape, bool)


def _sharing(c: np.ndarray, top: int, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_candidates`` of the pairs that share a bucket, as places of queries and rows. Most pairs share one, so the nearest
    are looked at first; only where too few of these do, all of a query's pairs are."""
    k, i = np.nonzero(_candidates(c, top + 8))
    own = (h[i] == g[k]).any(axis=1)
    few = np.flatnonzero(np.bincount(k[own], minlength=len(c)) < min(top, c.shape[1]))
    own &= ~np.isin(k, few)
    met = _met(h, g[few])
    more, rows = np.nonzero(met & _candidates(np.where(met, c[few], -np.inf), top))
    return np.concatenate([k[own], few[more]]), np.concatenate([i[own], rows])


def _block(rows: pa.Table, asked: pa.Table, top: int, hashed: bool) -> pa.Table:
    """(query_id, id, distance) of each query's ``top`` nearest rows of a part."""
    place, found = places(rows.column("id")), []
    h, g = (_buckets(rows.column("h")), _buckets(asked.column("h"))) if hashed and len(rows) and len(asked) else (None, None)
    vectors = [(at, x, _norms(x)) for at, x in _by_length(rows.column("embedding"))] if len(rows) else []
    for to, every in _by_length(asked.column("query_vector")) if len(asked) else []:
        step = max(1, HELD // max(1, len(rows)))
        norms = _norms(every)
        for start in range(0, len(to), step):
            own, q, qn = to[start : start + step], every[start : start + step], norms[start : start + step]
            for at, x, xn in vectors:
                n = qn[:, None] * xn[None, :]
                c = q @ x.T / n if x.shape[1] == q.shape[1] else np.full(n.shape, np.nan)
                c = np.where(n == 0, 0.0, np.clip(np.where(np.isnan(c), 1.0, c), -1.0, 1.0))
                if hashed:
                    if x.shape[1] != q.shape[1]:
                        raise ValueError("vectors of one length are needed")
                    k, i = _sharing(c, top, h[at], g[own])
                    d = _gaps(x / np.where(xn == 0, 1.0, xn)[:, None], q / np.where(qn == 0, 1.0, qn)[:, None], i, k)
                    k, i, d = k[d == d], i[d == d], d[d == d]
                else:
                    k, i = np.nonzero(_candidates(c, top))
                    d = _cosines(x, q, xn, qn, i, k)
                d = rounded(d)
                best = firsts(k, top, d, place[at[i]])
                found.append((own[k[best]], at[i[best]], d[best]))
    k, i, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    best = firsts(k, top, d, place[i])
    k, i, d = k[best], i[best], d[best]
    return pa.table({"query_id": asked.column("query_id").take(pa.array(k)), "id": rows.column("id").take(pa.array(i)), "distance": pa.array(d)})


def _most(df: DataFrame, on: list[str]) -> int:
    """The rows of the largest group."""
    counts = df.groupBy(*on).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def dealt(left: DataFrame, right: DataFrame, parts: int, blocks: int, on: list[str], groups: int = 1):
    """Both tables' groups by ``on``, part and block: ``parts`` parts of the left by id, ``blocks`` of the right by query_id."""
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*on, "part", "block"]
    tasks = min(2_000, 2 * parts * blocks * groups)
    left = left.withColumn("part", number("id", parts)).withColumn("block", every(blocks))
    right = right.withColumn("block", number("query_id", blocks)).withColumn("part", every(parts))
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))


def nearest(rows: DataFrame, asked: DataFrame, top: int, on: tuple[str, ...] = (), groups: int = 1, hashed: bool = False, queries: int = QUERIES) -> DataFrame:
    """(query_id, id, distance), each query's ``top`` nearest rows of each part, among which are the ``top`` nearest of all.

    rows: id, embedding; asked: query_id, query_vector; both with the columns of ``on``, whose values (about ``groups``
    different ones) must be equal. ``hashed``: both have ``h``, an array of buckets, of which one must be equal too."""
    n, m = _most(rows, [*on]), _most(asked, [*on])
    spread = 1 if on else min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS)
    parts, blocks = max(1, spread, -(-n // ROWS)), max(1, -(-m // queries))
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            return _block(left, right, top, hashed)

    schema = f"query_id {kind(asked, 'query_id')}, id {kind(rows, 'id')}, distance double"
    return dealt(rows, asked, parts, blocks, [*on], groups).applyInArrow(block, schema)


#: Postings of a part, and queries of a block of weights.
POSTINGS, WEIGHED = 2_000_000, 256


def _scores(postings: pa.Table, weights: pa.Table, top: int, least: float, k1: float, b: float) -> pa.Table:
    """(query_id, id, score, len) of each query's ``top`` best documents of a part, by one product of a few documents' terms with all weights."""
    terms = pc.unique(weights.column("term"))
    term = pc.index_in(postings.column("term"), value_set=terms).to_numpy()
    postings, term = postings.filter(pa.array(~np.isnan(term))), term[~np.isnan(term)].astype(np.int64)
    coded = lambda c: pc.dictionary_encode(c.combine_chunks(), null_encoding="encode")
    queries, ids = coded(weights.column("query_id")), coded(postings.column("id"))
    asked, doc, length = queries.indices.to_numpy(), ids.indices.to_numpy().astype(np.int64), postings.column("len").to_numpy().astype(np.int64)
    wide = int(length.max(initial=0)) + 1
    docs, doc = np.unique(doc * wide + length, return_inverse=True)
    w = np.zeros((len(terms), len(queries.dictionary)))
    w[pc.index_in(weights.column("term"), value_set=terms).to_numpy(), asked] = weights.column("times").to_numpy() * weights.column("idf").to_numpy()
    tf = postings.column("tf").to_numpy()
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / weights.column("avgdl")[0].as_py()))
    order = np.argsort(doc, kind="stable")
    doc, term, part = doc[order], term[order], part[order]
    step, floor, found = max(32, HELD // max(w.shape)), np.full(w.shape[1], -np.inf), []
    for start in range(0, len(docs), step):
        n = min(step, len(docs) - start)
        own = slice(*np.searchsorted(doc, [start, start + n]))
        met = np.bincount((doc[own] - start) * len(terms) + term[own], weights=part[own], minlength=n * len(terms)).reshape(n, len(terms))
        raw = met @ w
        if n > top:
            floor = np.maximum(floor, np.partition(raw, n - top, axis=0)[n - top] - MARGIN)
        at, q = np.nonzero((raw > least) & (raw >= floor))
        found.append((q, at + start, raw[at, q]))
    q, at, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    own = score >= floor[q]
    q, at, score = q[own], at[own], rounded(score[own])
    id = docs[at] // wide
    best = firsts(q, top, -score, places(pa.chunked_array([ids.dictionary]))[id]) if len(q) else np.zeros(0, int)
    take = lambda c, i: c.take(pa.array(i[best]))
    return pa.table({"query_id": take(queries.dictionary, q), "id": take(ids.dictionary, id), "score": pa.array(score[best]), "len": pa.array((docs[at] % wide)[best].astype(np.int32))})


def best_scores(postings: DataFrame, weights: DataFrame, size: int, top: int, least: float, k1: float, b: float) -> DataFrame:
    """(query_id, id, score, len), each query's ``top`` best documents of each part, among which are the ``top`` best of all.

    postings: id, len, term, tf (about ``size`` rows); weights: query_id, term, times, idf, avgdl. Postings are dealt by document,
    so no row is made for a document and a query; what is shuffled are the postings."""
    queries = weights.select("query_id").distinct().count()
    parts, blocks = max(1, -(-size // POSTINGS)), max(1, -(-queries // WEIGHED))
    if parts == 1:
        parts = max(1, min(postings.sparkSession.sparkContext.defaultParallelism, size // (POSTINGS // 16)))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(weights, 'query_id')}, id {kind(postings, 'id')}, score double, len int"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            return _scores(left, right, top, least, k1, b)
        none = lambda c: c.slice(0, 0)
        return pa.table({"query_id": none(right.column("query_id")), "id": none(left.column("id")), "score": pa.array([], pa.float64()), "len": pa.array([], pa.int32())})

    return dealt(postings.select("id", "len", "term", "tf"), weights, parts, blocks, []).applyInArrow(score, schema)


#: Tokens or terms that a task looks at once, unless one document has more.
TERMS = 1 << 18


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``most``, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, end
        start = end


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def _counts(batches: Iterator[pa.RecordBatch], wanted: pa.Array) -> Iterator[pa.RecordBatch]:
    """(id, len, terms, tfs) of rows (id, tokens): how often each wanted term is in a text. Null tokens have a null length."""
    wide = max(1, len(wanted))
    for batch in batches:
        for start, end in pieces(_sizes(batch.column(1)), TERMS):
            ids, tokens = batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start)
            code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=wanted), -1).to_numpy()
            row = np.repeat(np.arange(len(ids)), _sizes(tokens))
            pair, tf = np.unique(row[code >= 0] * wide + code[code >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(ids) + 1) * wide).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, wanted.take(pa.array(pair % wide)))
            tfs = pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, pc.list_value_length(tokens), terms, tfs], ["id", "len", "terms", "tfs"])


def counts(docs: DataFrame, wanted: pa.Array) -> DataFrame:
    """(id, len, terms, tfs) of rows (id, tokens), each in its own task; ``wanted`` are a checked number of terms."""
    return docs.mapInArrow(lambda batches: _counts(batches, wanted), f"id {docs.schema['id'].dataType.simpleString()}, len int, terms array<string>, tfs array<int>")


def _matrices(weights: pa.Table, queries: pa.Array) -> list[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(queries, terms, times x idf) of blocks of queries; a query that comes twice has two columns."""
    out = []
    for start in range(0, len(queries), WEIGHED):
        block = queries.slice(start, WEIGHED)
        ids = block.unique()
        own = weights.filter(pc.is_in(weights.column("query_id"), value_set=ids))
        terms = own.column("term").combine_chunks().unique()
        w = np.zeros((len(terms), len(ids)))
        at = [pc.index_in(own.column(c), value_set=v).to_numpy() for c, v in (("term", terms), ("query_id", ids))]
        w[at[0], at[1]] = own.column("times").to_numpy() * own.column("idf").to_numpy()
        out.append((block, terms, w[:, pc.index_in(block, value_set=ids).to_numpy()]))
    return out


def all_scores(counted: DataFrame, weights: DataFrame, least: float, k1: float, b: float, every: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, len) of documents (id, len, terms, tfs) and queries whose score is above ``least``; with ``every``, a table
    of query ids, of all pairs, 0.0 where no term meets or an id is null. weights: query_id, term, times, idf, avgdl; the numbers
    of weights and of query ids have been checked.

    A document has its terms with it, so a task makes its documents' pairs by products and passes them on: no pair is shuffled or held."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema, all_pairs = f"query_id {kind(weights, 'query_id')}, id {kind(counted, 'id')}, score double, len int", every is not None
    held = weights.toArrow()
    queries = (held if every is None else every.toArrow()).column("query_id").combine_chunks()
    if all_pairs:
        held = held.filter(pc.is_valid(held.column("query_id")))
    avgdl = held.column("avgdl")[0].as_py() if len(held) else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _matrices(held, queries if all_pairs else queries.unique())
        for whole in batches:
            for first, last in pieces(_sizes(whole.column(2)), TERMS):
                batch = whole.slice(first, last - first)
                n, (ids, lens, lists, tfs) = batch.num_rows, batch.columns
                doc = np.repeat(np.arange(n), _sizes(lists))
                tf, flat = tfs.flatten().to_numpy(), pc.dictionary_encode(lists.flatten())
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * pc.fill_null(lens, 0).to_numpy()[doc] / avgdl))
                if all_pairs:
                    part[pc.is_null(ids).to_numpy(zero_copy_only=False)[doc]] = 0.0
                for block, terms, w in made:
                    term = pc.fill_null(pc.index_in(flat.dictionary, value_set=terms), -1).to_numpy()[flat.indices.to_numpy()]
                    met, step = np.flatnonzero(term >= 0), max(1, HELD // max(w.shape))
                    for start in range(0, n, step):
                        m = min(step, n - start)
                        own = met[slice(*np.searchsorted(doc[met], [start, start + m]))]
                        x = np.bincount((doc[own] - start) * len(terms) + term[own], weights=part[own], minlength=m * len(terms))
                        raw = x.reshape(m, len(terms)) @ w
                        at, q = np.divmod(np.arange(raw.size), raw.shape[1]) if all_pairs else np.nonzero(raw > least)
                        row = pa.array(at + start)
                        yield pa.RecordBatch.from_arrays([block.take(pa.array(q)), ids.take(row), pa.array(rounded(raw[at, q])), lens.take(row)], ["query_id", "id", "score", "len"])

    return counted.mapInArrow(run, schema)
