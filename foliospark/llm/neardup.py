"""MinHash near-dedup by a chosen-path set similarity join (operator 4).

A document is the set of its distinct word shingles (five words, by 64-bit
hashes). Documents with equal sets form a class, and only classes are compared.

Each class has ``COORDS`` minwise tokens, of which a sketch keeps four bits each.
In ``TREES`` independent trees it is in the root node that one chosen token of its
own names. A node of at most ``LEAF`` classes is compared exhaustively by sketches; a
larger one branches again by ``BRANCH`` tokens that its place in the tree chooses, until
its children are small. Two sets of the least similarity J share no root with the
probability (1 - J) ** TREES, 6e-8 for J = 0.75; where all their roots branch without
end, a root loses them with the probability 1/9, and all of them with 2e-6.

A pair whose sketches have fewer than ``least_equal`` equal tokens is left out; a linked
pair falls below it with a probability under 1e-7. All others are candidates. A node gives
no pairs but, for each group of classes that candidates connect, the links of all to its
smallest key: fewer rows than it has. The groups of all nodes, united, are the families:
every link is inside one. Then each class's text goes to its family once, and the
task that has the family confirms links on full sets: each pair of candidates, unless
confirmed links have joined the two before.

Sizes that one task can't hold take the same steps over several tasks. A node of more than
``TASK`` classes is compared in random blocks and branches by Spark (``Levels``); so is a
family of more than ``FAMILY`` classes or ``FAMILY_BYTES`` of packed text, whose texts then
go to the nodes that its classes have in common.

Nothing is collected on the driver but counts of rows. Intermediate tables
are written to the shared scratch folder.

Defined cases: a null or empty text, or one of white space only, has no
shingles, is linked with nothing and is its own component; a text of fewer than
five words has one shingle, the whole sequence; repeated rows of one doc_id
belong to the component of that row's text; the smallest doc_id of a component
leaves null ids out, and a row with a null doc_id is not kept; texts of any length
are read whole, a very long one alone in its batch; classes tied in similarity
or in their tokens are compared like others; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from foliospark.llm.common import LOWER, UPPER, Scratch, blank_spans, hash_spans, mix, small_batches

WORDS, PERCENT = 5, 75
COORDS, TREES, BRANCH, LEAF, MAX_DEPTH = 128, 12, 2, 1024, 24
#: Classes of a node, and classes and packed bytes of a family, that one task compares.
TASK, FAMILY, FAMILY_BYTES = 16_384, 4_096, 8 << 20
#: Rows that go from a task to Spark at a time.
BATCH = 5_000
_FACTORS = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_PLACES = mix(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)
_ONES = np.uint64(0x1111111111111111)


def least_equal(percent: int = PERCENT) -> int:
    """Equal tokens below which a pair is left out: 5.5 standard deviations low."""
    j = percent / 100
    p = j + (1 - j) / 16  # four bits of different tokens may be equal
    return max(1, math.floor(COORDS * p - 5.5 * math.sqrt(COORDS * p * (1 - p))))


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    low, starts, ends = blank_spans(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = hash_spans(low, starts, ends)
    if len(words) < WORDS:
        whole = hashlib.blake2b(words.tobytes(), digest_size=8).digest()
        return np.frombuffer(whole, np.uint64).copy()
    n = len(words) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h = mix(h + words[k : k + n] * _PLACES[k])
    return np.unique(h)


def minwise(found: np.ndarray) -> np.ndarray:
    """The minimum of each of COORDS hash orders."""
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * _FACTORS).min(0), out=least)
    return least


def sketch_of(least: np.ndarray) -> bytes:
    """The upper four bits of each token, two in a byte."""
    bits = (least >> np.uint64(60)).astype(np.uint8)
    return (bits[0::2] << 4 | bits[1::2]).tobytes()


def fingerprints(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, key, nodes, sketch, blob, *extra) of each row of (doc_id, text, *extra).

    ``key`` names the set, ``nodes`` are its root nodes, ``blob`` holds the compressed words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        salt = np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40)
        for part in small_batches(batches, "text"):
            n, key, nodes, sketch, blob = [], [], [], [], []
            for raw in part.column(1).cast(pa.binary()):
                raw = raw.as_py() or b""
                found = shingles(raw)
                n.append(len(found))
                if not len(found):
                    for x in (key, nodes, sketch, blob):
                        x.append(None)
                    continue
                least = mix(minwise(found))
                key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                nodes.append(mix(least[:TREES] + salt).view(np.int64))
                sketch.append(sketch_of(least))
                blob.append(pack(b" ".join(raw.lower().split())))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(nodes, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(blob, pa.binary()),
                 *part.columns[2:]],
                ["doc_id", "n_shingles", "key", "nodes", "sketch", "blob", *extra],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(
        run, f"doc_id long, n_shingles long, key binary, nodes array<long>, sketch binary, blob binary{more}"
    )


# ------------------------------------------------------- inside a task


class Parts:
    """Disjoint sets of a group's rows, begun with their labels."""

    def __init__(self, labels: list):
        number: dict = {}
        self.up = [number.setdefault(x, i) for i, x in enumerate(labels)]
        self.n = len(number)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.n -= 1
        return a != b

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in rows.tolist()])


def equal_tokens(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many tokens of each sketch (a row of 64-bit words) are those of ``one``."""
    x = sketches ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return COORDS - np.bitwise_count(x & _ONES).sum(axis=1, dtype=np.int64)


#: Bytes of unpacked sets that a task keeps; sets beyond it are unpacked at each use.
KEPT_BYTES = 100 << 20


class Sets:
    """The full sets of a group's rows."""

    def __init__(self, blobs: list[bytes], percent: int):
        self.blobs, self.percent, self.unpack = blobs, percent, zstandard.ZstdDecompressor().decompress
        self.known: dict[int, np.ndarray] = {}
        self.size = 0

    def words(self, i: int) -> np.ndarray:
        if (found := self.known.get(i)) is None:
            found = shingles(self.unpack(self.blobs[i]))
            if self.size < KEPT_BYTES:
                self.known[i] = found
                self.size += found.nbytes
        return found

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose sets are similar enough to that of row i."""
        mine, out = self.words(i), []
        for at in range(0, len(others), 256):
            part = others[at : at + 256]
            sets = [self.words(k) for k in part.tolist()]
            every = np.concatenate(sets)
            place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            sizes = np.array([len(x) for x in sets])
            both = np.add.reduceat((mine[place] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            out.append(part[100 * both >= self.percent * (len(mine) + sizes - both)])
        return np.concatenate(out)


def compare(rows: np.ndarray, tokens: np.ndarray, parts: Parts, least: int, sets: Sets | None) -> None:
    """Joins the rows that candidates connect, or confirmed links where ``sets`` are given.

    Rows of one part are reached together, so each pair of different parts is looked at once at most.
    """
    open_, words = rows, tokens[rows]
    members: dict[int, list[int]] = {}
    for i, p in zip(rows.tolist(), parts.of(rows).tolist()):
        members.setdefault(p, []).append(i)
    done = np.zeros(len(tokens), bool)
    for first in members:
        if done[first_row := members[first][0]]:
            continue
        queue = list(members[first])
        done[queue] = True
        while queue:
            if 2 * np.count_nonzero(done[open_]) > len(open_):
                left = ~done[open_]
                open_, words = open_[left], words[left]
                if not len(open_):
                    break
            x = queue.pop()
            near = open_[equal_tokens(words, tokens[x]) >= least]
            near = near[~done[near]]
            if sets is not None and len(near):
                near = sets.linked(x, near)
            for p in set(parts.of(near).tolist()) if len(near) else ():
                if p in members and not done[members[p][0]]:
                    queue += members[p]
                    done[members[p]] = True
                    parts.join(first_row, members[p][0])


def branch(rows: np.ndarray, tokens: np.ndarray, parts: Parts, least: int, place: int = 0, depth: int = 0) -> None:
    """Joins the rows of a node that candidates connect; nodes over LEAF branch."""
    if len(rows) <= LEAF or depth == MAX_DEPTH:
        return compare(rows, tokens, parts, least, None)
    label = parts.of(rows)
    for part in np.array_split(rows, -(-len(rows) // LEAF)):  # large groups of copies join here
        compare(part, tokens, parts, least, None)
    label, first, count = np.unique(parts.of(rows), return_index=True, return_counts=True)
    if len(label) <= LEAF:
        compare(rows[first], tokens, parts, least, None)
        label, count = np.unique(parts.of(rows), return_counts=True)
    if len(label) == 1:
        return None
    if len(rows) - count.max() <= LEAF:  # the few outside the largest part, with all
        return compare(rows, tokens, parts, least, None)
    bits = tokens[rows].view(np.uint8)
    for j in range(BRANCH):
        child = int(mix(np.array([place * BRANCH + j + 1], np.uint64))[0])
        at = child % COORDS
        token = bits[:, at // 2] >> (0 if at % 2 else 4) & 15
        for t in range(16):
            if np.count_nonzero(own := token == t) > 1:
                branch(rows[own], tokens, parts, least, child * 16 + t & (1 << 56) - 1, depth + 1)
    return None


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``by`` columns (none null), if more than one."""
    held: list[pa.RecordBatch] = []

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in range(by):
            col = batch.column(c)
            if pa.types.is_integer(col.type):
                x = col.to_numpy()
                new |= x[1:] != x[:-1]
            else:
                new |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new) + 1

    def name(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in range(by))

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, *edges(batch).tolist(), batch.num_rows]
        if held and name(held[-1], held[-1].num_rows - 1) == name(batch, 0):
            held.append(batch.slice(0, cuts[1]))
            cuts = cuts[1:]
            if len(cuts) == 1:
                continue
        if held and sum(x.num_rows for x in held) > 1:
            yield whole()
        held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            if b - a > 1:
                yield batch.slice(a, b - a)
        held = [batch.slice(cuts[-2], cuts[-1] - cuts[-2])]
    if held and sum(x.num_rows for x in held) > 1:
        yield whole()


def sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, COORDS // 16)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield flush()
            held = []
    yield flush()


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def stars(parts: Parts, rows: list[int], keys: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """The links of each part of several rows to its smallest key; they keep paths short."""
    members: dict[int, list[bytes]] = {}
    for i in rows:
        members.setdefault(parts.root(i), []).append(keys[i])
    for own in members.values():
        if len(own) > 1 and (least := min(own)) != max(own):
            yield from ((least, k) for k in own if k != least)


def _connected(least: int) -> Callable:
    """The links of a node's classes that candidates connect; rows (node, block, label, key, sketch)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for group in groups(batches, 2):
            parts, tokens = Parts(group.column("label").to_pylist()), sketches(group)
            begun = parts.n
            branch(np.arange(group.num_rows), tokens, parts, least)
            if parts.n < begun:
                yield from stars(parts, list(range(group.num_rows)), group.column("key").to_pylist())

    return lambda batches: _batches(found(batches), _PAIR)


def _screened(least: int) -> Callable:
    """The rows (node, block, label, key) of a cell that are candidates with a row of another label."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in groups(batches, 2):
            tokens = sketches(group)
            number: dict = {}
            label = np.array([number.setdefault(x, len(number)) for x in group.column("label").to_pylist()])
            most = np.bincount(label).argmax()
            few = np.flatnonzero(label != most)  # each pair has one row at least that isn't of the largest part
            met = np.zeros(len(label), bool)
            for i in few.tolist():
                near = (equal_tokens(tokens, tokens[i]) >= least) & (label != label[i])
                if near.any():
                    met |= near
                    met[i] = True
            rows = group.select(["node", "block", "label", "key"]).to_pylist()
            yield from (tuple(rows[i].values()) for i in np.flatnonzero(met).tolist())

    schema = pa.schema([("node", pa.int64()), ("block", pa.int32()), ("label", pa.binary()), ("key", pa.binary())])
    return lambda batches: _batches(found(batches), schema)


def _confirmed(least: int, percent: int) -> Callable:
    """The links of a cell's classes that confirmed links join; rows (node, block, label, key, sketch, blob)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for group in groups(batches, 2):
            parts, begun = Parts(group.column("label").to_pylist()), group.num_rows
            sets = Sets(group.column("blob").to_pylist(), percent)
            compare(np.arange(begun), sketches(group), parts, least, sets)
            yield from stars(parts, list(range(begun)), group.column("key").to_pylist())

    return lambda batches: _batches(found(batches), _PAIR)


def _settled(least: int, percent: int) -> Callable:
    """(key, component) of the classes of whole families; rows (label, key, first, sketch, blob)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        for group in groups(batches, 1):
            n = group.num_rows
            parts, sets = Parts(list(range(n))), Sets(group.column("blob").to_pylist(), percent)
            compare(np.arange(n), sketches(group), parts, least, sets)
            first, least_of = group.column("first").to_pylist(), {}
            for i in range(n):
                ids = [x for x in (first[i], least_of.get(parts.root(i))) if x is not None]
                least_of[parts.root(i)] = min(ids, default=None)
            for i, key in enumerate(group.column("key").to_pylist()):
                yield key, least_of[parts.root(i)]

    schema = pa.schema([("key", pa.binary()), ("component", pa.int64())])
    return lambda batches: _batches(found(batches), schema)


# ------------------------------------------------------ across tasks


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """(key, label) of all linked keys: the smallest key of each one's component; None without links.

    Each round gives every key the smallest key it is linked with as parent, if that is smaller,
    jumps once from parents to their parents, and renames the links by that; links that then
    have equal ends are done. Few rounds are left, as links come as stars. Joins on a key that many
    links have are sort-merge joins, which Spark splits.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    labels, step = None, 0
    while True:
        edges = scratch.save(links.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct(), f"{name}-edges{step}")
        if edges.isEmpty():
            return labels
        up = edges.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("label"))
        top = up.select(F.col("key").alias("label"), F.col("label").alias("top"))
        up = up.join(top.hint("merge"), "label", "left").select("key", F.coalesce("top", "label").alias("label"))
        up = scratch.save(up, f"{name}-up{step}")
        for c in ("a", "b"):
            of = up.select(F.col("key").alias(c), F.col("label").alias("to")).hint("merge")
            links = (edges if c == "a" else links).join(of, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        if labels is None:
            every = up.unionByName(up.select(F.col("label").alias("key"), "label"))
            labels = every.groupBy("key").agg(F.min("label").alias("label"))  # a parent is smaller than its key
        else:
            to = up.select(F.col("key").alias("label"), F.col("label").alias("to"))
            labels = labels.join(to.hint("merge"), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
        labels = scratch.save(labels, f"{name}-labels{step}")
        step += 1


def united(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """The components after further links, of which only those that they join are walked again."""
    if labels is None:
        return components(links, scratch, name)
    side = lambda k: labels.select(F.col("key").alias(k), F.col("label").alias(f"l{k}")).hint("merge")
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")
    )
    ends = scratch.save(ends.filter("la <> lb"), f"{name}-ends")
    over = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch, f"{name}-over")
    if over is None:
        return labels
    fresh = ends.select(F.col("a").alias("key"), F.col("la").alias("label")).union(ends.select("b", "lb"))
    every = labels.union(fresh.filter("key = label")).distinct()
    over = over.select(F.col("key").alias("label"), F.col("label").alias("top")).hint("merge")
    return scratch.save(every.join(over, "label", "left").select("key", F.coalesce("top", "label").alias("label")), name)


class Levels:
    """Nodes that one task can't hold: blocks first, then what is still apart, else their children.

    ``classes`` have (key, nodes, sketch) and, where links are ``exact``, blob; ``most`` is the
    number of classes that one task compares.
    """

    def __init__(self, classes: DataFrame, scratch: Scratch, name: str, percent: int, exact: bool, most: int):
        self.classes, self.scratch, self.name, self.percent = classes, scratch, name, percent
        self.exact, self.most, self.least = exact, most, least_equal(percent)

    def side(self, *columns: str) -> DataFrame:
        return self.classes.select("key", *columns).hint("merge")

    def links(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) from cells of rows (node, block, label, key); tokens go to
        every row of a cell, texts only to the rows of candidate pairs."""
        dealt = lambda d: d.repartition("node", "block").sortWithinPartitions("node", "block", "label", "key")
        cell = ["node", "block", "label", "key"]
        tokens = dealt(rows.select(cell).join(self.side("sketch"), "key").select(*cell, "sketch"))
        if not self.exact:
            return tokens.mapInArrow(_connected(self.least), "a binary, b binary")
        near = tokens.mapInArrow(_screened(self.least), "node long, block int, label binary, key binary")
        texts = dealt(near.join(self.side("sketch", "blob"), "key").select(*cell, "sketch", "blob"))
        return texts.mapInArrow(_confirmed(self.least, self.percent), "a binary, b binary")

    def labelled(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(node, key, label, n, few, major) in nodes of more than one component: ``major`` is the
        node's largest component, ``few`` the number of classes outside it."""
        rows = rows.select("node", "key")
        if labels is None:
            rows = rows.withColumn("label", F.col("key"))
        else:
            rows = rows.join(labels.hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        parts = rows.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(
            F.sum("c").alias("n"), F.max_by("label", "c").alias("major"),
            (F.sum("c") - F.max("c")).alias("few"), F.count("*").alias("parts"),
        )
        return rows.join(parts.filter("parts > 1").drop("parts").hint("merge"), "node")

    def walk(self, frontier: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """The components after all links of the nodes of ``frontier`` (node, key)."""
        save, most = self.scratch.save, self.most
        for depth in range(MAX_DEPTH + 1):
            rows = save(self.labelled(frontier, labels), f"{self.name}-rows{depth}")
            if rows.isEmpty():
                break
            blocks = F.ceil(F.col("n") / most).cast("int")
            block = F.pmod(F.xxhash64("key", "node"), F.greatest(blocks, F.lit(1))).cast("int")
            labels = united(labels, save(self.links(rows.withColumn("block", block)), f"{self.name}-links{depth}"), self.scratch, f"{self.name}-{depth}")
            rows = save(self.labelled(rows.filter(F.col("n") > most), labels), f"{self.name}-apart{depth}")
            if rows.isEmpty():
                break
            last = F.lit(depth == MAX_DEPTH)
            few = rows.filter((F.col("few") <= most) | last).withColumn("other", F.col("label") == F.col("major"))
            blocks = F.greatest(F.ceil((F.col("n") - F.col("few")) / most).cast("int"), F.lit(1))
            mine = F.array(F.pmod(F.xxhash64("key"), blocks).cast("int"))
            every = F.sequence(F.lit(0), blocks - 1)  # the few outside meet each block of the others
            few = few.withColumn("block", F.explode(F.when(F.col("other"), mine).otherwise(every)))
            labels = united(labels, save(self.links(few), f"{self.name}-few{depth}"), self.scratch, f"{self.name}-{depth}few")
            child = []
            for j in range(BRANCH):
                at = F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDS)).cast("int")
                byte = F.conv(F.hex(F.substring("sketch", F.floor(at / 2).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
                token = F.when(at % 2 == 0, F.shiftright(byte, 4)).otherwise(byte.bitwiseAND(15))
                child.append(F.xxhash64("node", F.lit(j), token))
            frontier = rows.filter((F.col("few") > most) & ~last).select("node", "key").join(
                self.side("sketch"), "key").select("key", F.explode(F.array(*child)).alias("node"))
            frontier = save(frontier.distinct(), f"{self.name}-frontier{depth}")
        return labels


def families(classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """(key, label) of the classes that candidates connect, over all trees."""
    rows = classes.select(F.explode("nodes").alias("node"), "key", "sketch")
    large = scratch.save(rows.groupBy("node").count().filter(F.col("count") > TASK).select("node"), "large")
    some = not large.isEmpty()
    small = rows.join(large.hint("merge"), "node", "left_anti") if some else rows
    cells = small.select("node", F.lit(0).alias("block"), F.col("key").alias("label"), "key", "sketch")
    found = cells.repartition("node").sortWithinPartitions("node").mapInArrow(_connected(least_equal(percent)), "a binary, b binary")
    labels = components(found, scratch, "families")
    if some:
        deep = rows.select("node", "key").join(large.hint("merge"), "node", "left_semi")
        labels = Levels(classes, scratch, "families-deep", percent, False, TASK).walk(deep, labels)
    return labels


def confirmed(labels: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(key, component) of the classes in families: the smallest doc_id that confirmed links reach."""
    mine = labels.hint("shuffle_hash").join(classes, "key").select(
        "label", "key", "first", "sketch", "blob", F.length("blob").alias("bytes"), "nodes")
    mine = scratch.save(mine, "members")
    sizes = mine.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    large = scratch.save(sizes.filter((F.col("n") > FAMILY) | (F.col("bytes") > FAMILY_BYTES)).select("label"), "large-families")
    some = not large.isEmpty()
    small = mine.join(large.hint("merge"), "label", "left_anti") if some else mine
    out = (
        small.select("label", "key", "first", "sketch", "blob").repartition("label").sortWithinPartitions("label", "key")
        .mapInArrow(_settled(least_equal(percent), percent), "key binary, component long")
    )
    if not some:
        return scratch.save(out, "components")
    big = scratch.save(mine.join(large.hint("merge"), "label", "left_semi"), "large-members")
    levels = Levels(big, scratch, "deep", percent, True, FAMILY)
    # First a family in random blocks, as one node, which joins large groups of copies; then its root nodes.
    found = None
    blocks = big.select("label", "key").join(sizes.hint("merge"), "label").select(
        F.xxhash64("label").alias("node"), F.col("label").alias("family"), "key", "n", "bytes"
    )
    parts = F.ceil(F.greatest(F.col("n") / FAMILY, F.col("bytes") / FAMILY_BYTES)).cast("int")
    cells = blocks.select("node", F.pmod(F.xxhash64("key"), parts).cast("int").alias("block"), F.col("key").alias("label"), "key")
    found = components(scratch.save(levels.links(cells), "blocks"), scratch, "deep-blocks")
    found = levels.walk(big.select(F.explode("nodes").alias("node"), "key"), found)
    if found is None:
        return scratch.save(out, "components")
    named = big.select("key", "first").join(found.hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component"))
    return scratch.save(out.unionByName(named.join(lowest.hint("merge"), "label").select("key", "component")), "components")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, *extra) of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    prints = scratch.save(fingerprints(docs, extra), "prints")
    first = lambda *columns: [F.first(c).alias(c) for c in columns]
    classes = scratch.save(
        prints.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), *first("nodes", "sketch", "blob")),
        "classes",
    )
    labels = families(classes, scratch, percent)
    named = classes.select("key", F.col("first").alias("component_id"))
    if labels is not None:
        found = confirmed(labels, classes, scratch, percent)
        named = named.join(found.hint("merge"), "key", "left").select(
            "key", F.coalesce("component", "component_id").alias("component_id"))
    rows = prints.select("doc_id", "n_shingles", "key", *extra).join(named.hint("merge"), "key", "left")
    out = rows.select(
        "doc_id", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *extra,
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    result = Scratch(docs.sparkSession, "neardup").save(out, "result")
    scratch.drop("")
    return result


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_SHINGLES = rf"""list_distinct(list_transform(range(1, greatest(len(ws) - {WORDS} + 1, 1) + 1), lambda s: array_to_string(list_slice(ws, s, s + {WORDS} - 1), ' ')))"""

#: Compares all pairs of classes that share a shingle: for small tables.
ORACLE_SQL = rf"""
with recursive docs as (
    select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws
    from documents),
sets as (select k, doc_id, case when len(ws) = 0 then [] else {_SHINGLES} end as xs from docs),
keyed as (select k, doc_id, len(xs) as n, case when len(xs) > 0 then md5(array_to_string(list_sort(xs), chr(10))) end as class, xs from sets),
classes as (select class, min(doc_id) as first_id, any_value(n) as n, any_value(xs) as xs from keyed where class is not null group by class),
rows as (select class, n, unnest(xs) as x from classes),
pairs as (
    select a.class as a, b.class as b, a.n + b.n as total, count(*) as same
    from rows a join rows b on a.x = b.x and a.class < b.class and 100 * a.n >= {PERCENT} * b.n and 100 * b.n >= {PERCENT} * a.n
    group by a.class, b.class, a.n, b.n),
links as (select a, b from pairs where 100 * same >= {PERCENT} * (total - same)),
ways as (select a, b from links union all select b, a from links),
reach(class, other) as (select class, class from classes union select r.class, w.b from reach r join ways w on w.a = r.other),
lowest as (select r.class, min(c.first_id) as component_id from reach r join classes c on c.class = r.other group by r.class)
select doc_id, cast(n as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id,
    coalesce(doc_id = coalesce(component_id, doc_id), false) as kept
from keyed left join lowest using (class)
"""
