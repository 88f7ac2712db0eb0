"""Keyed state that ends: admission and lifetimes with timers, by ``transformWithState``.

The folds are those of ``keyed``; here each key's state, or that of a bucket of keys, has an event-time timer. When the
watermark passes the moment from which the state can't change any decision, the timer clears it, so the state store
holds the keys of the last window alone, or of buckets that have such keys. The session needs the RocksDB state store (``state_store``).

Events of one trigger are taken in order of time and then id; events behind the watermark are
dropped by Spark, and counted in the query's progress.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliospark.streaming.keyed import Admission, Lifetime

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events of one row of a fold's output.
ROWS = 10_000
#: Buckets of keys of the registered queries' streams.
BUCKETS = 256


class state_store:  # noqa: N801
    """Sets the session's state store to RocksDB for queries that start inside; sets it back at the end."""

    name = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.name, None)
        self.conf.set(self.name, ROCKSDB)

    def __exit__(self, *_):
        self.conf.unset(self.name) if self.before is None else self.conf.set(self.name, self.before)


class _Admissions:
    """The folds of ``keyed.Admission``: what they keep, and when that no longer matters."""

    def __init__(self, micros: int, most: int):
        self.micros, self.most = micros, most

    def fold(self, times: list[int]) -> Admission:
        return Admission(self.micros, self.most, tuple(times))

    def kept(self, fold: Admission) -> list[int]:
        return list(fold.times)

    def ends(self, times: list[int]) -> int:
        return max(times) + self.micros


class _Lifetimes:
    """The folds of ``keyed.Lifetime``, likewise."""

    def __init__(self, micros: int):
        self.micros = micros

    def fold(self, times: list[int]) -> Lifetime:
        return Lifetime(self.micros, *times)

    def kept(self, fold: Lifetime) -> list[int]:
        return [fold.until]

    def ends(self, times: list[int]) -> int:
        return times[0]


class _Expiring(StatefulProcessor):
    """Folds whose state is a list of times, in a group for each key.

    Each call of a group's state passes a socket, so there are as few as can be. State and timer are touched only if the fold has
    changed them; a group that has state has one timer, whose time follows from the state. Of a trigger that spans much time, most
    keys' state has ended by the trigger's own events, as the next watermark is at most ``late`` (micros) before each of them: it is
    not written. ``late`` None writes it always."""

    def __init__(self, rule: _Admissions | _Lifetimes, late: int | None):
        self.rule, self.late = rule, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times, self.seen = handle, self.state(handle), -(1 << 62)

    def state(self, handle: StatefulProcessorHandle):
        return handle.getValueState("times", "times array<long>")

    def read(self, key: tuple) -> dict[str | None, list[int]]:
        """The times of each of the group's keys that has state."""
        known = self.times.get()
        return {key[0]: list(known[0])} if known else {}

    def write(self, known: dict, times: dict) -> None:
        if times != known:
            self.times.update((list(times.values())[0],)) if times else self.times.clear()

    def lasts(self, times: list[int]) -> bool:
        """Whether events of later triggers may meet the times."""
        return bool(times) and (self.late is None or self.rule.ends(times) > self.seen // 1000 * 1000 - self.late)

    def move_timer(self, known: dict, times: dict) -> None:
        """The group's timer is when the last of its lists of times ends."""
        old, new = (max((self.rule.ends(t) // 1000 + 1 for t in lists.values()), default=None) for lists in (known, times))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def decide(self, key: tuple, names: list, codes: list[int], ats: list[int]) -> list[bool]:
        """What the folds say of a group's events, which come by key (``names`` has the key of each code) and in order."""
        known = self.read(key)
        times, said, last = dict(known), [], -1
        for code, at in zip(codes, ats):
            if code != last:
                if last >= 0:
                    times[names[last]] = self.rule.kept(fold)
                fold, last = self.rule.fold(known.get(names[code], [])), code
            said.append(fold(at))
        times[names[last]] = self.rule.kept(fold)
        self.seen = max(self.seen, max(ats))
        times = {name: t for name, t in times.items() if self.lasts(t)}
        self.write(known, times)
        self.move_timer(known, times)
        return said

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ids, none, ats = array("q"), array("b"), array("q")
        for event_id, _, at, _ in rows:
            ids.append(event_id or 0)
            none.append(event_id is None)
            ats.append(at)
        order = np.lexsort((ids, none, ats)).tolist() if len(ats) > 1 else [0]
        said = self.decide(key, [key[0]], [0] * len(order), [ats[k] for k in order])
        for k in range(0, len(order), ROWS):
            part = order[k : k + ROWS]
            yield Row(event_id=[None if none[i] else ids[i] for i in part], said=said[k : k + ROWS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Bucketed(_Expiring):
    """The same in a group for each bucket of keys, whose times are a map by key: what a group costs, many keys share.

    A task holds a bucket's events of one trigger as a frame, and its keys' times that still matter."""

    def state(self, handle: StatefulProcessorHandle):
        return handle.getMapState("times", "key string", "times array<long>")

    def read(self, key: tuple) -> dict[str | None, list[int]]:
        return {name: list(times) for (name,), (times,) in self.times.iterator()}

    def write(self, known: dict, times: dict) -> None:
        for name in known.keys() - times.keys():
            self.times.removeKey((name,))
        for name, t in times.items():
            if t != known.get(name):
                self.times.updateValue((name,), (t,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        codes, names = pd.factorize(frame["key"], use_na_sentinel=False)
        ids, ats = frame["event_id"], frame["at"].to_numpy()
        order = np.lexsort((ids.to_numpy(), ids.isna().to_numpy(), ats, codes))
        said = np.empty(len(order), bool)
        said[order] = self.decide(key, [None if pd.isna(x) else x for x in names], codes[order].tolist(), ats[order].tolist())
        yield pd.DataFrame({"event_id": ids, "said": said})


#: Units of a watermark's delay, in micros.
UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def _micros(late: str) -> int | None:
    """A delay such as "10 minutes"; None for other forms."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", late.lower())
    return int(found[1]) * UNITS[found[2]] if found and found[2] in UNITS else None


def _stream(events: DataFrame, key: str, late: str, rule: _Admissions | _Lifetimes, out: str, buckets: int | None) -> DataFrame:
    """The stream's watermark is the one that is set here, with no other below it."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_id", F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at"), ts.alias("ts")).withWatermark("ts", late)
    if buckets is None:
        # A row is a key's events of the trigger, in lists: a frame or a row for each event would cost more than the fold.
        made = rows.groupBy("key").transformWithState(_Expiring(rule, _micros(late)), "event_id array<long>, said array<boolean>", "Append", "EventTime")
        said = made.select(F.inline(F.arrays_zip("event_id", "said")))
    else:
        grouped = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket")
        said = grouped.transformWithStateInPandas(_Bucketed(rule, _micros(late)), "event_id long, said boolean", "Append", "EventTime")
    return said.withColumnRenamed("said", out)


def admitted_stream(events: DataFrame, seconds: int = 60, most: int = 30, key: str = "user_id", late: str = "0 seconds", buckets: int | None = None) -> DataFrame:
    """(event_id, admitted) of a stream (event_id, key, ts); as ``keyed.admitted`` for events in order. With ``buckets``, for many keys of
    few events each, state is grouped by so many buckets of keys; a checkpoint keeps its number."""
    return _stream(events, key, late, _Admissions(seconds * 1_000_000, most), "admitted", buckets)


def ttl_stream(events: DataFrame, seconds: int = 60, key: str = "key", late: str = "0 seconds", buckets: int | None = None) -> DataFrame:
    """(event_id, hit) of a stream (event_id, key, ts); as ``keyed.ttl_hits`` for events in order. ``buckets`` as in ``admitted_stream``."""
    return _stream(events, key, late, _Lifetimes(seconds * 1_000_000), "hit", buckets)


def first_seen_stream(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first event of each key; later ones within the watermark's delay of it are dropped, and hits renew nothing.

    The looser form of ``ttl_stream``: Spark keeps a key until the watermark has passed its first event's time by ``within``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def session_traces(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Trace figures of each session of a key: events less than ``gap`` apart. Written once a session has closed (append mode)."""
    ts = F.col("ts").cast("timestamp")
    window = F.session_window("ts", gap).alias("session")
    sums = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(key, window).agg(
        F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, 3).alias("duration"),
        F.round(F.sum("value"), 4).alias("tokens"), F.count_if(F.col("event_type") == "click").alias("tool_calls"), F.count("*").alias("steps"),
    )
    return sums.select(key, F.col("session.start").alias("start"), "duration", "tokens", "tool_calls", "steps")


def sliding_rates(events: DataFrame, key: str = "user_id", window: str = "1 minute", slide: str = "10 seconds", most: int = 30, late: str = "1 minute") -> DataFrame:
    """Events of each key in each sliding window, and whether they are over the limit; written once the window has closed."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = stamped.groupBy(key, F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("over_limit"))


def late_rows(run: StreamingQuery) -> int:
    """How many rows a query has dropped as later than its watermark, by the progress that is held."""
    return sum(op.numRowsDroppedByWatermark for p in run.recentProgress for op in p.stateOperators)
