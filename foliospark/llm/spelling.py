"""Spelling variant grouping by searches in pairs of FM-indexes (operator 13).

Two words are near if one insertion, deletion or replacement of a code point makes one the other.
The one error lies in one half of a word, so that the other half stands unchanged at its end of
the near word. Each word is therefore filed under the halves that a word of its length, or one
more or less, may share with it, and looked up by its own two halves. Rows of one half meet by hash
in a bucket, so near words meet without any pair being written.

A task reads a bucket's words, sorted before its queries, and builds an FM-index over their
delimited text: of the reversed words where the left half is exact, of the plain words where the right
half is. From the interval of all words' ends a search narrows the suffix-rank interval by the exact
half, then extends across the other half, away from it, allowing one error. Queries advance
together, as arrays; a step that many queries share (equal intervals) is ranked once. A near word that
keeps the left half is found there and passed over in the other direction, so each is counted once.
Each query gives the number and the best of its near words in the bucket, and sums are taken by word.

A bucket of more than ``BLOCK`` filed words is cut in blocks of about ``BLOCK`` words and as many parts of
its queries, each part against each block: the work of a half that many words share is spread, but its
rows grow with the square of the words over ``BLOCK``.

A word's form has at least ``RATIO`` times its count, so chains are no longer than the digits of the
largest count, and roots take a few rounds of pointer doubling by joins.

Defined cases: a null text has no words; a null doc_id counts as the empty string in the damage; repeated
rows count again; of forms with equal counts the smallest by code points wins; words may have any length;
texts are read whole; an empty table, or one without words, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm.common import LOWER, UPPER, Scratch, tasks

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
RUNS = "[A-Za-zÀ-ÿ]"
BLOCK = 60_000  # words of an index
QUERIES = 2_000  # queries that advance together


# ------------------------------------------------------------------ the index


class Index:
    """An FM-index over words, each closed by 0; ``words`` are strings of code points up to 255."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0".join(words) + "\0").encode("latin-1"), np.uint8)
        ends = np.flatnonzero(text == 0)
        n = len(text)
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=-1))
        left = ends[word] - np.arange(n)  # letters up to the word's end
        rank, size, most = text.astype(np.int64), 1, int(left.max())
        while True:  # suffixes up to the end of their word, by doubled lengths; ties go by position
            ahead = np.where(left >= size, rank[np.minimum(np.arange(n) + size, n - 1)] + 1, 0)
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            first = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(first[1:] != first[:-1])))
            size *= 2
            if size > most:
                break
        before = np.where(order > 0, text[order - 1], 0)
        self.n, self.words = n, len(words)
        self.bwt = before.astype(np.int64)
        self.keys = np.sort(self.bwt * (n + 1) + np.arange(n))
        self.letters = np.unique(self.bwt[self.bwt > 0])
        self.starts = self.keys[: len(words)]  # suffixes that are whole words
        self.word = word[order[self.starts]]

    def narrow(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where suffix rank ``at`` goes when ``letter`` is put before the suffixes."""
        return np.searchsorted(self.keys, letter * (self.n + 1) + at)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All letters before the suffixes of each interval: interval's number (ascending), letter, narrowed interval."""
        size, many = hi - lo, len(self.letters)
        wide, slim = np.flatnonzero(size > many), np.flatnonzero((size <= many) & (size > 0))
        which = np.repeat(slim, size[slim])
        inside = np.arange(len(which)) - np.repeat(np.cumsum(size[slim]) - size[slim], size[slim])
        pairs = np.unique(which * 256 + self.bwt[lo[which] + inside])
        which = np.concatenate((pairs >> 8, np.repeat(wide, many)))
        letter = np.concatenate((pairs & 255, np.tile(self.letters, len(wide))))
        which, letter = which[letter > 0], letter[letter > 0]
        low, high = self.narrow(letter, lo[which]), self.narrow(letter, hi[which])
        some = np.flatnonzero(high > low)
        some = some[np.argsort(which[some], kind="stable")]
        return which[some], letter[some], low[some], high[some]


def near(index: Index, letters: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the index) whose word ends with the query's last ``exact`` letters and has one error before.

    ``letters`` has a query's letters from its last to its first in a row."""
    query = np.arange(len(length))
    lo, hi = np.zeros(len(length), np.int64), np.full(len(length), index.words)
    for at in range(int(exact.max(initial=0))):
        on = (at < exact[query]) & (hi > lo)
        keep = on | (at >= exact[query])
        query, lo, hi, on = query[keep], lo[keep], hi[keep], on[keep]
        c = letters[query, at]
        lo, hi = np.where(on, index.narrow(c, lo), lo), np.where(on, index.narrow(c, hi), hi)
    keep = hi > lo
    query, lo, hi = query[keep], lo[keep], hi[keep]
    at = exact[query]  # letters of the query that were read
    none = np.zeros(0, np.int64)
    err = (none, none, none, none)  # states with their error made: query, interval, letters read
    while len(query) or len(err[0]):
        # one letter more of those that have their error; the ended ones wait
        eq, elo, ehi, eat = err
        on = eat < length[eq]
        c = letters[eq[on], eat[on]]
        elo[on], ehi[on], eat[on] = index.narrow(c, elo[on]), index.narrow(c, ehi[on]), eat[on] + 1
        parts = [tuple(x[ehi > elo] for x in (eq, elo, ehi, eat))]
        if len(query):
            spot, back = np.unique(lo * (index.n + 1) + hi, return_inverse=True)
            which, letter, low, high = index.children(spot // (index.n + 1), spot % (index.n + 1))
            count = np.bincount(which, minlength=len(spot))
            begin = np.cumsum(count) - count
            each = np.repeat(np.arange(len(query)), count[back])  # the states by their intervals' children
            child = np.arange(len(each)) - np.repeat(np.cumsum(count[back]) - count[back], count[back]) + begin[back][each]
            q, pos = query[each], at[each]
            more = pos < length[q]
            same = np.zeros(len(each), bool)
            same[more] = letters[q[more], pos[more]] == letter[child[more]]
            parts.append((q, low[child], high[child], pos.copy()))  # a letter that the query lacks
            swap = more & ~same
            parts.append((q[swap], low[child[swap]], high[child[swap]], pos[swap] + 1))  # another letter
            here = at < length[query]
            parts.append((query[here], lo[here], hi[here], at[here] + 1))  # a letter that the word lacks
            query, lo, hi, at = q[same], low[child[same]], high[child[same]], pos[same] + 1
        err = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(query) and (err[3] == length[err[0]]).all():
            break
    first, last = np.searchsorted(index.starts, err[1]), np.searchsorted(index.starts, err[2])
    found = last > first  # different words: an interval has one whole word at most
    pairs = np.unique(err[0][found] * index.words + index.word[first[found]])
    return pairs // index.words, pairs % index.words


# ------------------------------------------------------------------- the task


def _reports(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each query of each bucket: number and best of its near words there. Rows are sorted by side, bucket,
    block, part and kind, words before queries."""
    now, words, counts, index = None, [], [], None
    for batch in batches:
        names = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        place = np.stack([names[c].to_numpy(zero_copy_only=False) for c in ("side", "bucket", "block", "part", "kind")], 1)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            side, *rest, kind = place[a].tolist()
            if now != (side, *rest):
                now, words, counts, index = (side, *rest), [], [], None
            got, n = names["word"].slice(a, b - a).to_pylist(), names["n"].slice(a, b - a).to_numpy()
            if kind == 0:
                words += got
                counts.append(n)
                continue
            if index is None and words:
                index = (Index(["".join(reversed(w)) for w in words] if side == 0 else words), np.concatenate(counts))
            for at in range(0, len(got), QUERIES):
                yield _answers(index, words, side, got[at : at + QUERIES], n[at : at + QUERIES], schema)


def _answers(index, words: list[str], side: int, queries: list[str], n: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    count, best, best_n = np.zeros(len(queries), np.int64), [None] * len(queries), np.zeros(len(queries), np.int64)
    if index:
        fm, sizes = index
        length = np.array([len(q) for q in queries])
        half = length // 2
        letters = np.zeros((len(queries), int(length.max()) + 1), np.int64)
        for i, q in enumerate(queries):
            codes = np.frombuffer(q.encode("latin-1"), np.uint8)
            letters[i, : len(codes)] = codes if side == 0 else codes[::-1]
        for i, w in zip(*(x.tolist() for x in near(fm, letters, length, half if side == 0 else length - half)), strict=True):
            word, size = words[w], sizes[w]
            if side and word.startswith(queries[i][: half[i]]):
                continue  # the left half stands too: found from there
            count[i] += 1
            if size > best_n[i] or (size == best_n[i] and word < best[i]):
                best[i], best_n[i] = word, size
    return pa.RecordBatch.from_arrays(
        [pa.array(queries, pa.string()), pa.array(n), pa.array(count), pa.array(best_n, mask=count == 0), pa.array(best, pa.string())], schema=schema
    )


# ------------------------------------------------------------------ the tables


def vocabulary(docs: DataFrame) -> DataFrame:
    """The words of all documents after the contract's damage, with their counts (``word``, ``n``)."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{RUNS}{{{LEAST_LENGTH},}}"), F.lit(0)))
    runs = docs.select("doc_id", run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    damaged = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    kept = damaged.filter(F.length("word") >= LEAST_LENGTH)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _filed(words: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Words under the halves that near words may look for, and words by their own halves (side 0: left, 1: right)."""
    size = F.length("word")
    bucket = lambda half: F.pmod(F.xxhash64("side", half), F.lit(buckets)).cast("int")

    def half(long: Column) -> Column:
        left = F.substring("word", F.lit(1), (long / 2).cast("int"))
        keep = long - (long / 2).cast("int")
        return F.when(F.col("side") == 0, left).otherwise(F.substring("word", -keep, keep))

    sides = words.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = F.array_distinct(F.array(*[bucket(half(size + d)) for d in (-1, 0, 1)]))
    filed = sides.select("word", "n", "side", F.explode(keys).alias("bucket"))
    return filed, sides.select("word", "n", "side", bucket(half(size)).alias("bucket"))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each word (``word``, ``n``): ``n_near``, and ``best_n`` and ``best`` of its near words (null if none).

    ``words`` is a written table of different words."""
    spark = words.sparkSession
    buckets = max(4 * tasks(spark), math.ceil(4 * words.count() / block) * 2)
    filed, asked = _filed(words, buckets)
    hot = filed.groupBy("side", "bucket").agg(F.count("*").alias("filed")).filter(F.col("filed") > block)
    hot = Scratch(spark, "spelling").save(hot.select("side", "bucket", F.ceil(F.col("filed") / block).cast("int").alias("cuts")), "hot")

    def dealt(df: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        """Rows of hot buckets take one of the cuts by their word, and stand in all cuts of the other kind."""
        cuts = F.coalesce("cuts", F.lit(1))
        # at most one row for each ``block`` filed words: the hint is safe at any size of the vocabulary
        df = df.join(F.broadcast(hot), ["side", "bucket"], "left").withColumn(own, F.pmod(F.xxhash64("word", F.lit(3)), cuts).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), cuts - 1)))
        return df.select("side", "bucket", "block", "part", F.lit(kind).alias("kind"), "word", "n")

    rows = dealt(filed, 0, "block", "part").unionByName(dealt(asked, 1, "part", "block"))
    place = ["side", "bucket", "block", "part"]
    n = max(tasks(spark), min(buckets, 4 * tasks(spark)))
    rows = rows.repartition(n, *place).sortWithinPartitions(*place, "kind")
    out = "word string, n long, n_near long, best_n long, best string"
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    found = rows.mapInArrow(lambda b: _reports(b, schema), out)
    order = F.when(F.col("n_near") > 0, F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    each = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best"))
    return each.select("word", "n", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def groups(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Form and root of each word (``word``, ``n``: a written table), with ``n_near`` and ``form_n``."""
    scratch = Scratch(words.sparkSession, "spelling")
    form = F.col("best_n") >= RATIO * F.col("n")
    found = near_words(words, block).select(
        "word", "n", "n_near", F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")
    )
    found = scratch.save(found, "forms")
    most = found.agg(F.max("n")).first()[0] or 0
    links = found.filter("form is not null").select("word", F.col("form").alias("root"))
    # forms have ``RATIO`` times the count, so a chain has fewer steps than the largest count has digits
    for k in range(max(0, math.ceil(math.log2(len(str(most)))))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        links = links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
        links = scratch.save(links, f"roots-{k}")
    out = found.join(links.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(Scratch(spark, "spelling").save(vocabulary(docs), "words"))


#: Near words by what is left when a letter is taken out.
ORACLE_SQL = r"""
with crc as (
  select list(list_reduce(list_prepend(b, range(8)), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from range(256) r(b)
), runs as (
  select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), counted as (
  select id, run, count(*) as n from runs group by all
), hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
      case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 + (unicode(c) >> 6))::bigint, (128 + (unicode(c) & 63))::bigint] end))),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from counted, crc
), damaged as (
  select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
), words as (
  select word, sum(n)::bigint as n from damaged where length(word) >= 7 group by word having sum(n) >= 2
), less as (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) u(i)
), pairs as (
  select distinct a.word, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
), best as (
  select word, count(*) as n_near, max(other_n) as most, min(other) filter (other_n = top) as other
  from (select *, max(other_n) over (partition by word) as top from pairs) group by word
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 10 * n then other end as form, case when most >= 10 * n then most end as form_n
  from words w left join best using (word)
), recursive_roots as (
  select f0.word, coalesce(f7.form, f6.form, f5.form, f4.form, f3.form, f2.form, f1.form, f0.form, f0.word) as root
  from forms f0 left join forms f1 on f1.word = f0.form left join forms f2 on f2.word = f1.form left join forms f3 on f3.word = f2.form
    left join forms f4 on f4.word = f3.form left join forms f5 on f5.word = f4.form left join forms f6 on f6.word = f5.form left join forms f7 on f7.word = f6.form
)
select word, form, root, n, n_near, form_n from forms join recursive_roots using (word)
"""
