"""Keyed folds over event time: admission limits and entries with a lifetime.

Each key's events are sorted within partitions and streamed through in Arrow
batches, so a key of any size needs only its own small state. ``expiring`` has the streaming forms.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Admission:
    """Admits an event if fewer than ``most`` admitted ones lie within the window before it."""

    def __init__(self, micros: int, most: int, times: tuple[int, ...] = ()):
        self.micros, self.most, self.times = micros, most, deque(times)

    def __call__(self, at: int) -> bool:
        while self.times and self.times[0] <= at - self.micros:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(at)
        return True


class Lifetime:
    """Whether an event finds an open entry; the first opens one, which hits don't renew."""

    def __init__(self, micros: int, until: int = -(1 << 62)):
        self.micros, self.until = micros, until

    def __call__(self, at: int) -> bool:
        if at < self.until:
            return True
        self.until = at + self.micros
        return False


def _fold(events: DataFrame, key: str, out: str, new: Callable) -> DataFrame:
    rows = events.select("event_id", F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = object(), None
        for frame in frames:
            said = []
            for k, at in zip(frame["key"], frame["at"]):
                if k != name:
                    name, state = k, new()
                said.append(state(at))
            yield pd.DataFrame({"event_id": frame["event_id"], out: said})

    return dealt.mapInPandas(run, f"event_id long, {out} boolean")


def admitted(events: DataFrame, seconds: int = 60, most: int = 30, key: str = "user_id") -> DataFrame:
    """(event_id, admitted) of rows (event_id, key, ts)."""
    return _fold(events, key, "admitted", lambda: Admission(seconds * 1_000_000, most))


def ttl_hits(events: DataFrame, seconds: int = 60, key: str = "key") -> DataFrame:
    """(event_id, hit) of rows (event_id, key, ts)."""
    return _fold(events, key, "hit", lambda: Lifetime(seconds * 1_000_000))


def trace_stream(events: DataFrame, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Running trace figures of each key, for update mode."""
    from foliospark.operators.logs import trace_summary

    return trace_summary(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), key)
