"""Benchmark decontamination (operator 6).

The windows of all benchmark items form one Aho-Corasick automaton over words:
each word of the benchmark has a code point of its own, every other word is
code point 0, and a document becomes one string of code points that is scanned
once. A match ends at a word; the word's byte span in the original text gives
the offset there.

The automaton is broadcast only within a stated bound (``max_windows``). A
larger benchmark is cut into blocks of items of at most that many windows (an
item of more is cut between its windows); each block's automaton scans the
documents once, and the hits of all blocks are merged by document row.

Defined cases: a null or empty text has no words, no hits and is not
contaminated; benchmark rows with null or empty texts have no window; repeated
benchmark rows with one ``item_id`` count as one item; an item without id counts
under the id ``null``; repeated documents are judged row by row; a word inside several
windows is hit once; texts of any length are scanned whole; an empty
benchmark contaminates nothing; further columns are ignored or carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliospark.llm.common import LOWER, UPPER, Scratch, alnum_spans, alnum_words, runs, small_batches

WINDOW = 13
#: Windows of one automaton: about 13 nodes each, so under about 100 MB in a worker.
MAX_WINDOWS = 50_000

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
    T.StructField("hit_words", T.ArrayType(T.LongType())),
])


def item_windows(text: bytes, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item: ``size`` words each, or all words if there are fewer."""
    words = alnum_words(text)
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Matcher:
    """The automaton of one block of windows."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[str]]]):
        self.code: dict[bytes, str] = {}
        self.items: list[list[str]] = []
        self.auto = ahocorasick.Automaton()
        for words, items in windows:
            key = "".join(self.code.setdefault(w, _code_point(len(self.code))) for w in words)
            self.auto.add_word(key, (len(words), len(self.items)))
            self.items.append(items)
        if windows:
            self.auto.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words; (first word, word after the last, window) of each match."""
        words = alnum_words(text)
        if not self.items or not words:
            return len(words), []
        get = self.code.get
        line = "".join([get(w, "\0") for w in words])
        return len(words), [(e + 1 - n, e + 1, k) for e, (n, k) in self.auto.iter(line)]


def _code_point(n: int) -> str:
    """The n-th code point from 1, without surrogates."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 1 + 0x800)


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, shared) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value)
    return _matchers[key]


def char_offsets(text: bytes, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in UTF-8 text."""
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(leads)))[at]


def _scan(docs: DataFrame, windows: list, text: str) -> DataFrame:
    """One pass of an automaton over the documents; adds the columns of RESULT."""
    key = hashlib.sha256(repr(windows).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared)
        for batch in small_batches(batches, text):
            rows = []
            for raw in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
                raw = raw.as_py() or b""
                n, found = matcher.scan(raw)
                if not found:
                    rows.append((n, 0, 0, [], [], []))
                    continue
                step = np.zeros(n + 1, np.int64)
                for a, b, _ in found:
                    step[a] += 1
                    step[b] -= 1
                hit = np.cumsum(step)[:n] > 0
                starts, ends = runs(hit)
                _, first, last = alnum_spans(raw)
                chars = char_offsets(raw, np.concatenate((first[starts], last[ends - 1])))
                items = sorted({x for _, _, k in found for x in matcher.items[k]})
                half = len(starts)
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(chars[:half], chars[half:])]
                rows.append((n, int(hit.sum()), len(items), items, spans, np.flatnonzero(hit).tolist()))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            new = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new], [*batch.schema.names, *RESULT.names]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))


def window_table(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids of the items that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for w in item_windows(raw.as_py() or b"", size):
                    ids.append("null" if i is None else i)
                    found.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "words"])

    pairs = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return pairs.mapInArrow(run, "item string, words binary").groupBy("words").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def with_hits(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS,
    text: str = "text",
) -> DataFrame:
    """Adds RESULT's columns to each row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``spans`` are
    their runs as character offsets in the original text, ``item_ids`` the items
    with occurring windows, as sorted strings. Columns of these names in
    ``docs`` are replaced.
    """
    spark = docs.sparkSession
    kept = docs.select([c for c in docs.columns if c.lower() not in RESULT.names])
    scratch = Scratch(spark, "decontam")
    windows = scratch.save(window_table(benchmark, size), "windows")
    total = windows.count()
    if total <= max_windows:
        block = [(tuple(bytes(r.words).split(b" ")), r["items"]) for r in windows.collect()]
        scratch.drop("windows")
        return _scan(kept, sorted(block), text)
    # Beyond the bound: one pass for each block of windows, merged by row.
    blocks = -(-2 * total // max_windows)
    numbered = scratch.save(kept.withColumn("__row", F.expr("uuid()")), "rows")
    parts = []
    for b in range(blocks):
        # By hash, so a block has half of max_windows, give or take its square root.
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        block = [(tuple(bytes(r.words).split(b" ")), r["items"]) for r in rows.collect()]
        hits = _scan(numbered.select("__row", text), sorted(block), text).drop(text)
        parts.append(scratch.save(hits.filter("n_hit > 0"), f"hits{b}"))
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    merged = joined.groupBy("__row").agg(
        F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("__hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"),
    )
    return _from_merged(numbered.join(merged.hint("merge"), "__row", "left"), text).drop("__row", "__hit", "__items")


def _from_merged(rows: DataFrame, text: str) -> DataFrame:
    """RESULT's columns from the merged hit words of several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            at = batch.schema.get_field_index
            out = []
            for raw, hit, items in zip(batch.column(at(text)).cast(pa.binary()), batch.column(at("__hit")), batch.column(at("__items"))):
                raw, where, items = raw.as_py() or b"", sorted(hit.as_py() or []), items.as_py() or []
                _, first, last = alnum_spans(raw)
                mask = np.zeros(len(first), bool)
                mask[where] = True
                starts, ends = runs(mask)
                chars = char_offsets(raw, np.concatenate((first[starts], last[ends - 1])))
                half = len(starts)
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(chars[:half], chars[half:])]
                out.append((len(first), len(where), len(items), items, spans, where))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            new = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *RESULT.fields]))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document, and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"), F.to_json("spans").alias("spans"),
    )


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# The words, each with what stands between it and the word before.
_PIECES = rf"regexp_extract_all({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
with docs as (select row_number() over () as k, doc_id, {_WORDS} as ws, {_PIECES} as pieces from documents),
items as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as ws from benchmark),
windows as (
    select distinct item, least({WINDOW}, len(ws)) as n, array_to_string(list_slice(ws, s, s + least({WINDOW}, len(ws)) - 1), ' ') as w
    from (select item, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) as s from items where len(ws) > 0)),
places as (
    select k, s, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') as w
    from (select k, ws, n, unnest(range(1, len(ws) - n + 2)) as s
          from docs join (select distinct n from windows) sizes on len(ws) >= n)),
found as (select k, s, n, item from places join windows using (n, w)),
hit as (select distinct k, p from (select k, unnest(range(s, s + n)) as p from (select distinct k, s, n from found))),
hits as (select k, count(*) as n_hit from hit group by k),
ends as (
    select k, p, sum(len(piece)) over (partition by k order by p) as e, len(word) as n
    from (select k, unnest(pieces) as piece, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from docs semi join hits using (k))),
islands as (
    select k, min(e - n) as a, max(e) as b
    from (select k, p, e, n, p - row_number() over (partition by k order by p) as island from hit join ends using (k, p)) group by k, island),
marked as (select k, '[' || string_agg('{{"start":' || a::bigint || ',"end":' || b::bigint || '}}', ',' order by a) || ']' as spans from islands group by k),
of as (select k, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct k, item from found) group by k)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) as contaminated,
    coalesce(spans, '[]') as spans
from docs left join hits using (k) left join marked using (k) left join of using (k)
"""
