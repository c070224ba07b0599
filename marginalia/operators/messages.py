"""Batch operators over inbound messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.shared import written


def dedup_key(msg_id: Column, create_time: Column) -> Column:
    """The identity of a message; missing parts are empty."""
    return F.concat_ws("_", F.coalesce(msg_id, F.lit("")), F.coalesce(create_time, F.lit("")))


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]))


def passed(times: np.ndarray, ttl: int, last: int | None) -> list[int]:
    """Positions of the sorted times that are accepted after one accepted at ``last``."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + ttl))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + ttl))
    return out


def exits(times: np.ndarray, ttl: int) -> list[tuple[int, int]]:
    """(start, end): the last accepted time if the first accepted one is ``start``, for all starts that an earlier time can lead to.

    Starts with the same end as the one after them are left out.
    """
    after = np.searchsorted(times, times + ttl)
    end = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            end[i] = end[after[i]]
    reach = min(len(times), int(after[0]) + 1)
    keep = np.r_[end[1:reach] != end[: reach - 1], True]
    return list(zip(times[:reach][keep].tolist(), end[:reach][keep].tolist()))


_SUMMARY = "part int, first string, last string, exit long, starts array<long>, ends array<long>"


def _summaries(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """One row a partition: its first and last key, the last accepted time of the last one, and ``exits`` of the first."""
    part, keys, times = None, [], []
    rows: list[tuple] = []
    head: tuple | None = None  # first key with all its times
    held: list[np.ndarray] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(2)[0].as_py()
        keys, times = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
        for a, z in _groups(keys):
            if held and keys[a] != key:
                if head is None:
                    head = (key, np.concatenate(held))
                held = []
            key = keys[a]
            held.append(times[a:z])
    if held:
        t = np.concatenate(held)
        single = head is None
        head = head or (key, t)
        found = exits(head[1], ttl)
        at = passed(t, ttl, None)
        rows.append((part, head[0], key, None if single else int(t[at[-1]]), [x for x, _ in found], [x for _, x in found]))
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "first", "last", "exit", "starts", "ends"])


def _entries(summaries: list, ttl: int) -> dict[int, int]:
    """The last accepted time of each partition's first key before the partition, where there is one."""
    out, key, last = {}, None, None
    for r in sorted(summaries, key=lambda r: r["part"]):
        goes_on = last is not None and r["first"] == key
        if goes_on:
            out[r["part"]] = last
        if r["exit"] is not None:
            last = r["exit"]  # of another key than the first
        elif not goes_on:
            last = r["ends"][0] if r["starts"] else None
        else:
            at = int(np.searchsorted(np.array(r["starts"]), last + ttl))
            last = r["ends"][at] if at < len(r["ends"]) else last
        key = r["last"]
    return out


def _kept(batches: Iterator[pa.RecordBatch], ttl: int, entry: dict[int, int]) -> Iterator[pa.RecordBatch]:
    key, last, begun = None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        keys, times = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
        keep: list[int] = []
        for a, z in _groups(keys):
            if not begun:
                key, last, begun = keys[a], entry.get(b.column(2)[0].as_py()), True
            elif keys[a] != key:
                key, last = keys[a], None
            got = passed(times[a:z], ttl, last)
            if got:
                keep += [a + i for i in got]
                last = int(times[keep[-1]])
        yield b.select([0, 1]).take(pa.array(keep, pa.int64()))


def accepted(df: DataFrame, key: Column, ts: Column, ttl_seconds: int) -> DataFrame:
    """(dedup_key, ts) of the rows that a key-wise TTL accepts.

    A row is dropped if its key was *accepted* less than the TTL before; dropped rows don't
    renew it. Equal times of one key are dropped against each other; rows without a time are dropped.

    Rows are range-partitioned by key and time, so a hot key's history lies in several partitions. A first
    pass tells for each partition how the last accepted time before it decides the last one in
    it, the driver chains these (a row a partition, with the times of one TTL at most), and a second
    pass accepts the rows.
    """
    kind = df.select(ts.alias("ts")).schema["ts"].dataType
    ttl = ttl_seconds * 1_000_000
    one = df.select(F.coalesce(key, F.lit("")).alias("dedup_key"), F.unix_micros(ts.cast("timestamp")).alias("t")).where("t IS NOT NULL").distinct()
    parts = one.repartitionByRange("dedup_key", "t").sortWithinPartitions("dedup_key", "t")
    parts = written(parts.withColumn("part", F.spark_partition_id()))
    entry = _entries(parts.mapInArrow(lambda b: _summaries(b, ttl), _SUMMARY).collect(), ttl)
    kept = parts.mapInArrow(lambda b: _kept(b, ttl, entry), "dedup_key string, t long")
    return kept.select("dedup_key", F.timestamp_micros("t").cast(kind).alias("ts"))
