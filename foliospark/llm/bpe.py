"""Byte-level BPE encoding and decoding (operator 3).

Every match of the split pattern is encoded on its own. A segment tree over
the byte positions of the match holds, at each leaf, the rank of the pair that
starts there; its root is the smallest rank, leftmost first. A merge changes
the pair at the merged position and at its live left neighbour and clears the
swallowed one: three point updates of logarithmic cost. The trees of the short
matches that a batch of texts brings are merged in step, as rows of one array
(``Merger``); a long match has a tree of its own (``encode_piece``).

Defined cases: a null text counts as the empty text and has 0 tokens; bytes
that are not UTF-8 become U+FFFD as in Python's ``errors="replace"``; repeated
rows are encoded row by row; texts of any length are encoded whole, and one
match of any length costs n log n; of equal ranks the leftmost pair merges; an empty table gives an empty result; further
columns are ignored, or carried along if ``keep`` is set.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from foliospark.llm.common import small_batches

NO_PAIR = 1 << 62
#: Bounds of a worker's memory of encoded matches: entries, and bytes of one match.
MEMO_ENTRIES, MEMO_BYTES = 100_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    width = 1 << (n - 1).bit_length()
    shift = n.bit_length()
    places = (1 << shift) - 1
    tree = [NO_PAIR] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[width + i] = r << shift | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # of the token that starts at a position
    begin = list(range(n))  # of the token that ends before position + 1

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            value = value if value < other else other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    while (top := tree[1]) != NO_PAIR:
        i = top & places
        j = end[i]
        e = end[i] = end[j]
        begin[e - 1] = i
        put(j, NO_PAIR)
        r = get(piece[i : end[e]]) if e < n else None
        put(i, NO_PAIR if r is None else r << shift | i)
        if i:
            b = begin[i - 1]
            r = get(piece[b:e])
            put(b, NO_PAIR if r is None else r << shift | b)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Merger:
    """Encodes many short pieces at once: their segment trees are rows of one array and merge in step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaf value of a pair of tokens at a place: its rank, then the place."""
        if not len(self.keys):
            return np.full(np.broadcast(a, b).shape, NO_PAIR)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at] << 8 | place, NO_PAIR)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece of at most 256 bytes; all single bytes must be tokens."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, own in by_width.items():
            most = max(1, 65_536 // width)
            for at in range(0, len(own), most):
                part = own[at : at + most]
                for k, ids in zip(part, self.merged([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def merged(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = np.array([len(x) for x in pieces])
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(-1, width)
        place = np.arange(width)
        token = self.bytes[raw]
        tree = np.full((len(pieces), 2 * width), NO_PAIR)
        tree[:, width:-1] = np.where(place[1:] < n[:, None], self.pair(token[:, :-1], token[:, 1:], place[:-1]), NO_PAIR)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after, before = (np.tile(place + d, (len(pieces), 1)).ravel() for d in (1, -1))
        token, tree, alive = token.ravel(), tree.ravel(), (place < n[:, None]).ravel()

        def climb(root: np.ndarray, leaf: np.ndarray) -> None:
            leaf = leaf + width
            while leaf[0] > 1:
                leaf = leaf >> 1
                tree[root + leaf] = np.minimum(tree[root + 2 * leaf], tree[root + 2 * leaf + 1])

        rows = np.arange(len(pieces))
        while True:
            top = tree[rows * 2 * width + 1]
            rows, top = rows[top != NO_PAIR], top[top != NO_PAIR]
            if not len(rows):
                break
            base, root, i, rank = rows * width, rows * 2 * width, top & 255, top >> 8
            j = after[base + i]
            e = after[base + j]
            token[base + i], after[base + i], alive[base + j] = rank, e, False
            more = e < n[rows]
            before[(base + e)[more]] = i[more]
            tree[root + width + j] = NO_PAIR
            tree[root + width + i] = np.where(more, self.pair(rank, token[base + np.where(more, e, 0)], i), NO_PAIR)
            h = before[base + i]
            has = h >= 0
            left, ahead = root[has], h[has]
            tree[left + width + ahead] = self.pair(token[base[has] + ahead], rank[has], ahead)
            climb(root, j)
            climb(root, i)
            if len(left):
                climb(left, ahead)
        ids, ends = token[alive].tolist(), np.cumsum(alive.reshape(-1, width).sum(1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts; remembers the matches it has met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.merger = Merger(ranks) if all(bytes([b]) in ranks for b in range(256)) else None
        self.ids: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, str] = {}  # the ids in decimal digits, each after a space

    def learn(self, pieces: set[str]) -> None:
        """Encodes the matches that aren't remembered."""
        short, whole, get = [], [], self.ranks.get
        for piece in pieces:
            raw = piece.encode()
            if (rank := get(raw)) is not None:
                self.ids[piece] = (rank,)
            elif self.merger is None or len(raw) > MEMO_BYTES:
                self.ids[piece] = tuple(encode_piece(raw, self.ranks))
            else:
                short.append(piece)
                whole.append(raw)
        if short:
            self.ids.update(zip(short, self.merger.encode(whole)))
        ids = self.ids
        self.said.update([(p, " " + " ".join(map(str, ids[p]))) for p in pieces])

    def forget(self, pieces: set[str]) -> None:
        """Keeps the memory in its bounds."""
        if len(self.ids) > MEMO_ENTRIES:
            self.ids, self.said = {}, {}
        for piece in pieces:
            if len(piece) > MEMO_BYTES // 4:
                self.ids.pop(piece, None)
                self.said.pop(piece, None)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """The ids of each text, and their decimal digits."""
        found = [self.find(text) for text in texts]
        new = set().union(*found) - self.ids.keys()
        self.learn(new)
        ids, said = self.ids, self.said
        for own in found:
            yield list(chain.from_iterable([ids[p] for p in own])), "".join([said[p] for p in own])[1:]
        self.forget(new)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: A worker keeps the codec of the last vocabulary it has used.
_codecs: dict[str, Codec] = {}


def _codec(key: str, shared, pattern: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(dict(shared.value), pattern)
    return _codecs[key]


def with_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = True,
    digests: bool = False,
) -> DataFrame:
    """Adds ``n_tokens``, and ``token_ids`` and/or the digest columns, to each row.

    The vocabulary is read on the driver and broadcast; its size is that of the
    rank file and does not depend on the data. A column that already has one of
    the new names is replaced.
    """
    added = [T.StructField("n_tokens", T.LongType())]
    if ids:
        added.append(T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)))
    if digests:
        added += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    names = {f.name.lower() for f in added}
    carried = docs.select([c for c in docs.columns if c.lower() not in names])
    pairs = list(read_ranks(ranks_path).items())
    key = hashlib.sha256(repr((pairs, pattern)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, pattern)
        yield from encoded(batches, codec)
        codec.ids, codec.said = {}, {}  # the worker goes on to other tasks

    def encoded(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, text):
            counts, lists, sums, texts = [], [], [], []
            raws = part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            for got, said in codec.encode_all([(x or b"").decode("utf-8", "replace") for x in raws]):
                counts.append(len(got))
                if ids:
                    lists.append(pa.array(got, pa.int32()))
                if digests:
                    sums.append(hashlib.sha256(said.encode()).hexdigest())
                    texts.append(hashlib.sha256(codec.decode(got)).hexdigest())
            new = [pa.array(counts, pa.int64())]
            if ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                new.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(lists or [pa.array([], pa.int32())])))
            if digests:
                new += [pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *new], [*part.schema.names, *(f.name for f in added)]
            )

    return carried.mapInArrow(run, T.StructType([*carried.schema.fields, *added]))


def decode(tokens: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of a list of token ids; null for null."""
    shared = tokens.sparkSession.sparkContext.broadcast(list(read_ranks(ranks_path).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {r: t for t, r in shared.value}
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            raw = [None if x is None else b"".join(map(by_id.__getitem__, x)) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"]
            )

    carried = tokens.select([c for c in tokens.columns if c.lower() != "decoded"])
    return carried.mapInArrow(run, T.StructType([*carried.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ids=False, digests=True)
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
