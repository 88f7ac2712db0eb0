"""Shared helpers of the training-data operators: scratch tables and text kernels.

Scratch tables live under ``spark.checkpoint.dir`` (a folder that driver and
executors share), so that an executor which is lost takes no intermediate
result with it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# ----------------------------------------------------------------- scratch


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir``; where that is unset, a local session (tests) uses its warehouse
    folder. On a cluster that folder's default lies on each machine by itself, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"


class Scratch:
    """Intermediate tables of one operator call, written as Parquet.

    ``save`` writes a DataFrame and returns it as read back; ``drop`` deletes
    a table that is no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """A setting of the session for jobs over long texts: Arrow batches of at most ``rows`` rows,
    unless the session or its start has set a number itself; Spark's default lets batches of 64 MB stand in each
    task on both sides. The jobs (the registered queries and the pipeline's stages) call it, the operators
    don't. It stays, as a job's tasks begin only when its result is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(rows))


def small_batches(
    batches: Iterator[pa.RecordBatch], text: str | int = "text", rows: int = 512, size: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and, but for single rows, about ``size`` bytes of text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text) if isinstance(text, str) else text)
        lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, before + size, side="right")) - at
            n = min(max(1, fit), rows, batch.num_rows - at)
            yield batch.slice(at, n)
            at += n


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ------------------------------------------------------------ text kernels

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z; everything that is neither a-z, 0-9 nor non-ASCII becomes a space.
WORD_TABLE = bytes(
    b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]


def alnum_spans(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The translated text and the byte spans of its words."""
    low = text.translate(WORD_TABLE)
    return low, *runs(np.frombuffer(low, np.uint8) != 0x20)


def blank_spans(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with A-Z lower-cased, and the byte spans between white space."""
    low = text.lower()
    return low, *runs(~_SPACE[np.frombuffer(low, np.uint8)])


_K = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_LOW = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _K[1]
    h = (h ^ (h >> np.uint64(27))) * _K[2]
    return h ^ (h >> np.uint64(31))


def hash_spans(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes of every span at a time."""
    padded = text + b"\0" * 8
    view = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _K[0] + np.uint64(1))
    which, at = np.arange(len(starts)), starts
    while len(which):
        h[which] = mix((h[which] ^ (view[at] & _LOW[np.minimum(left, 8)])) + _K[0])
        left = left - 8
        more = left > 0
        which, at, left = which[more], at[more] + 8, left[more]
    return h
