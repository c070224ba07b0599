"""One bounded first-in-first-out queue for each key, with a timer for the item in front.

Events of a key, in order of time: ``add`` an item, ``start`` or ``drop`` the item in front,
``done`` with it. The first item of an idle key waits in front until it is started, by an
event or by its timer; later items queue up to ``capacity`` and start ``pause`` after they came to
the front. An item ``ask``ed about in front waits for an answer, and its timer drops it instead.
``Queue`` is the pure rule; the stream operator keeps one in state for each key, and ``replayed``
runs it over a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.config import QUEUE_CAPACITY, START_PAUSE_SECONDS, WAIT_SECONDS

OUTPUT = "key string, micros long, outcome string, item string, waiting int"


@dataclass
class Queue:
    """State of a key: the item in front, whether it runs, its deadline, and what waits behind it."""

    capacity: int = QUEUE_CAPACITY
    wait: int = WAIT_SECONDS * 1_000_000
    pause: int = START_PAUSE_SECONDS * 1_000_000
    front: str | None = None
    running: bool = False
    follows: bool = False  # the front came from the queue and starts by itself
    asked: bool = False  # the front needs a confirmation, else it is dropped
    deadline: int | None = None
    waiting: list[str] = field(default_factory=list)

    def _run(self) -> None:
        self.running, self.follows, self.asked, self.deadline = True, False, False, None

    def _next(self, at: int) -> None:
        self.front, self.running, self.follows, self.asked, self.deadline = None, False, False, False, None
        if self.waiting:
            self.front, self.follows, self.deadline = self.waiting.pop(0), True, at + self.pause

    def step(self, at: int, event: str, item: str | None = None) -> list[tuple[int, str, str]]:
        """What an event leads to: (time, outcome, item), after the timers that are due."""
        out = self.expire(at)
        say = lambda outcome, x: out.append((at, outcome, x))
        if event == "add" and item is not None:
            if self.front is None or not (self.running or self.follows):
                if self.front is not None:
                    say("dropped", self.front)
                self.front, self.asked, self.deadline = item, False, at + self.wait
                say("armed", item)
            elif len(self.waiting) >= self.capacity:
                say("refused", item)
            else:
                self.waiting.append(item)
                say("queued", item)
        elif self.front is None:
            pass
        elif event == "ask" and not self.running and not self.asked:
            self.asked, self.follows, self.deadline = True, False, at + self.wait
            say("asked", self.front)
        elif event == "start" and not self.running:
            self._run()
            say("started", self.front)
        elif event == "drop" and not self.running or event == "done" and self.running:
            say("dropped" if event == "drop" else "finished", self.front)
            self._next(at)
        return out

    def expire(self, at: int) -> list[tuple[int, str, str]]:
        """What the timers up to a time lead to."""
        out = []
        while self.front is not None and self.deadline is not None and at >= self.deadline:
            due = self.deadline
            if self.asked:
                out.append((due, "dropped", self.front))
                self._next(due)
            else:
                self._run()
                out.append((due, "started", self.front))
        return out


class QueueProcessor(StatefulProcessor):
    def __init__(self, capacity: int, wait_seconds: int):
        self.capacity, self.wait = capacity, wait_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "json string")

    def _load(self) -> Queue:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {}
        return Queue(self.capacity, self.wait, **kept)

    def _save(self, q: Queue, before: int | None) -> None:
        if before is not None and before != q.deadline:
            self.handle.deleteTimer(before // 1000)
        if q.deadline is not None and before != q.deadline:
            self.handle.registerTimer(q.deadline // 1000)
        if q.front is None:
            self.state.clear()
        else:
            kept = {k: getattr(q, k) for k in ("front", "running", "follows", "asked", "deadline", "waiting")}
            self.state.update((json.dumps(kept),))

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({
            "key": text([key[0]] * len(out)), "micros": pd.Series([o[0] for o in out], dtype="int64"), "outcome": text([o[1] for o in out]),
            "item": text([o[2] for o in out]), "waiting": pd.Series([o[3] for o in out], dtype="int32"),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        q = self._load()
        before, out = q.deadline, []
        for r in pd.concat(list(rows)).sort_values("micros", kind="stable").itertuples():
            out += [(t, o, item, len(q.waiting)) for t, o, item in q.step(r.micros, r.event, r.item)]
        self._save(q, before)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        q = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999
        out = [(t, o, item, len(q.waiting)) for t, o, item in q.expire(at)]
        if out:
            self._save(q, None)  # the timer has gone with its firing
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def keyed_queues(stream: DataFrame, key: str, ts: str, event: str, item: str, capacity: int = QUEUE_CAPACITY, wait_seconds: int = WAIT_SECONDS, delay: str = "1 minute") -> DataFrame:
    """(key, micros, outcome, item, waiting) of a stream of events; needs the RocksDB state store."""
    rows = stream.withWatermark(ts, delay).select(F.col(ts), F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("micros"), F.col(event).alias("event"), F.col(item).alias("item"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=QueueProcessor(capacity, wait_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


_REPLAYED = pa.schema([("key", pa.string()), ("micros", pa.int64()), ("outcome", pa.string()), ("item", pa.string()), ("waiting", pa.int32())])


def _replay(batches: Iterator[pa.RecordBatch], capacity: int, wait: int, until: int | None, state: bool) -> Iterator[pa.RecordBatch]:
    key, q, begun, rows = None, Queue(capacity, wait), False, []

    def close() -> None:
        for t, o, item in q.expire((1 << 62) if until is None else until):
            if not state:
                rows.append((key, t, o, item, len(q.waiting)))
        if state and q.front is not None:
            rows.append((key, q.deadline, "running" if q.running else "asked" if q.asked else "pausing" if q.follows else "armed", q.front, len(q.waiting)))

    def send() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_REPLAYED)], schema=_REPLAYED)
        rows.clear()
        return batch

    for b in batches:
        for k, at, event, item in zip(*(c.to_pylist() for c in b.columns)):
            if not begun or k != key:
                if begun:
                    close()
                key, q, begun = k, Queue(capacity, wait), True
            out = q.step(at, event, item)
            if not state:
                rows += [(k, t, o, x, len(q.waiting)) for t, o, x in out]
        yield send()
    if begun:
        close()
    yield send()


def _sorted(events: DataFrame, key: Column, ts: Column, event: Column, item: Column, until: Column | None) -> DataFrame:
    rows = events.select(F.coalesce(key, F.lit("")).alias("key"), F.unix_micros(ts.cast("timestamp")).alias("micros"), event.alias("event"), item.alias("item"))
    rows = rows.where(F.col("micros").isNotNull() & F.col("event").isNotNull())
    if until is not None:
        rows = rows.where(F.col("micros") <= until)
    return rows.repartition("key").sortWithinPartitions("key", "micros", "event", F.col("item").asc_nulls_first())


def replayed(events: DataFrame, key: Column, ts: Column, event: Column, item: Column, capacity: int = QUEUE_CAPACITY, wait_seconds: int = WAIT_SECONDS) -> DataFrame:
    """(key, micros, outcome, item, waiting): the rule over a table of events, with every timer that follows the last event.

    A key's events are one sequence and so run in one task, as a stream of rows that is never held whole.
    Null keys are the key ""; events without a time or a kind are none.
    """
    rows = _sorted(events, key, ts, event, item, None)
    return rows.mapInArrow(lambda b: _replay(b, capacity, wait_seconds * 1_000_000, None, False), OUTPUT)


def pending(events: DataFrame, key: Column, ts: Column, event: Column, item: Column, until_micros: int, capacity: int = QUEUE_CAPACITY, wait_seconds: int = WAIT_SECONDS) -> DataFrame:
    """(key, deadline, phase, item, waiting) of the keys that have an item in front at a time."""
    rows = _sorted(events, key, ts, event, item, F.lit(until_micros))
    state = rows.mapInArrow(lambda b: _replay(b, capacity, wait_seconds * 1_000_000, until_micros, True), OUTPUT)
    return state.select("key", F.col("micros").alias("deadline"), F.col("outcome").alias("phase"), "item", "waiting")
