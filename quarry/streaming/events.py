"""Change events: debouncing, the event ring, rate windows, and applying changes.

A window opens with a key's first event and lasts a fixed span; events within it only merge, and the
next event after it opens another. That is neither a tumbling nor a session window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = 256


def anchored_windows(events: DataFrame, keys: list[str], at: str, span: int, closed: bool = False) -> DataFrame:
    """``events`` with ``window``, per key from 0. ``at`` and ``span`` are numbers of one unit.

    A key's events are taken in order of time in a stream of sorted batches, so a key may have more of
    them than fit in memory at once.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema.fields)}, window long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, end = None, 0, None
        for b in batches:
            out = []
            for k, t in zip(b[keys].itertuples(index=False, name=None), b[at].tolist(), strict=True):
                if k != key:
                    key, n, end = k, 0, t + span
                elif t > end or (t == end and not closed):
                    n, end = n + 1, t + span
                out.append(n)
            yield b.assign(window=out)

    shuffled = events.repartition(*keys).sortWithinPartitions(*keys, at)
    return shuffled.mapInPandas(run, schema)


def debounce(events: DataFrame, keys: list[str], at: str, span: int) -> DataFrame:
    """One event per window: opened, published (the window's end), events, removed (it stays set)."""
    rows = anchored_windows(events, keys, at, span)
    return rows.groupBy(*keys, "window").agg(F.min(at).alias("opened"), (F.min(at) + span).alias("published"), F.count("*").alias("events"), F.max(F.col("action") == "removed").alias("removed"))


def rate_windows(requests: DataFrame, keys: list[str], at: str, span: int, most: int) -> DataFrame:
    """Requests of each window with how many were admitted; ``most`` 0: all."""
    rows = anchored_windows(requests, keys, at, span).groupBy(*keys, "window").agg(F.min(at).alias("opened"), F.count("*").alias("requests"))
    admitted = F.least("requests", F.lit(most).cast("long")) if most else F.col("requests")
    return rows.withColumn("admitted", admitted).withColumn("rejected", F.col("requests") - F.col("admitted"))


def event_ring(events: DataFrame, order: str, after: int = 0, size: int = RING) -> DataFrame:
    """The last ``size`` events, numbered from 1 over all, with numbers above ``after``: a replay.

    Numbers are given to the kept tail alone, from the count of all, so nothing sorts the whole table.
    """
    from pyspark.sql.window import Window

    tail = events.orderBy(F.desc(order)).limit(size)
    total = events.agg(F.count("*").alias("_n"))
    back = F.row_number().over(Window.orderBy(F.desc(order)))  # at most ``size`` rows
    rows = tail.withColumn("_back", back).join(F.broadcast(total)).withColumn("id", F.col("_n") - F.col("_back") + 1)
    return rows.filter(F.col("id") > after).drop("_n", "_back")


def debounce_stream(events: DataFrame, span_ms: int = 250) -> DataFrame:
    """Streaming form over corpus, path, action: state per key, published by a processing-time timer."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            removed, events_seen = state.get
            state.remove()
            yield pd.DataFrame([(*key, "removed" if removed else "changed", events_seen)], columns=["corpus", "path", "action", "events"])
            return
        removed, seen = state.get if state.exists else (False, 0)
        first = not state.exists
        for b in batches:
            removed, seen = removed or bool((b["action"] == "removed").any()), seen + len(b)
        state.update((removed, seen))
        if first:  # the first event alone sets the deadline
            state.setTimeoutDuration(max(span_ms, 1))

    return events.groupBy("corpus", "path").applyInPandasWithState(step, "corpus string, path string, action string, events long", "removed boolean, events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_stream(events: DataFrame, apply, checkpoint: str):
    """Start a query that hands each batch's changed and removed paths to ``apply(batch_id, changed, removed)``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("corpus", "path").agg(F.max(F.col("action") == "removed").alias("removed")).persist()
        apply(batch_id, last.filter("not removed").select("corpus", "path"), last.filter("removed").select("corpus", "path"))
        last.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")


class EventBus:
    """Hands each event to up to ``MOST`` subscribers, in the order in which they came, one after another."""

    MOST = 64

    def __init__(self) -> None:
        self._subscribers: dict[int, Callable[[dict], None]] = {}
        self._next = 0

    def subscribe(self, receive: Callable[[dict], None]) -> int:
        if len(self._subscribers) >= self.MOST:
            raise ValueError(f"more than {self.MOST} subscribers")
        self._next += 1
        self._subscribers[self._next] = receive
        return self._next

    def unsubscribe(self, number: int) -> None:
        self._subscribers.pop(number, None)

    def publish(self, event: dict) -> None:
        for receive in list(self._subscribers.values()):
            receive(event)
