"""The inbound message stream: decoding, exact and approximate de-duplication, idempotent sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.config import DEDUP_TTL_SECONDS
from marginalia.functions import web
from marginalia.operators.messages import dedup_key
from marginalia.operators.postings import PostingsIndex
from marginalia.operators.shared import Manifests, exists, written
from marginalia.operators.store import TIES, numbered, upsert_parts
from marginalia.schema import MESSAGE, NOTE, NOTE_COLUMNS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Messages from Parquet files as they appear under ``path``."""
    schema = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in MESSAGE])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decoded(stream: DataFrame, xml: str, ts: str) -> DataFrame:
    """Text messages of a stream of XML envelopes, with their de-duplication key; other types are dropped."""
    parsed = stream.select(F.col(ts).alias("ts"), *web.message_fields(F.col(xml)))
    return parsed.where("msg_type = 'text'").withColumn("dedup_key", dedup_key(F.col("msg_id"), F.col("create_time")))


def dedup_within_watermark(stream: DataFrame, key: str, ts: str, ttl: int = DEDUP_TTL_SECONDS) -> DataFrame:
    """Built-in de-duplication: at least the TTL, by the watermark; state is bounded."""
    return stream.withWatermark(ts, f"{ttl} seconds").dropDuplicatesWithinWatermark([key])


class TtlDedup(StatefulProcessor):
    """Passes a row unless its key passed less than the TTL before; dropped rows don't renew it."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        passed = known
        table = pd.concat(list(rows)).sort_values("micros", kind="stable")
        keep = []
        for t in table["micros"].tolist():
            keep.append(passed is None or t - passed >= self.ttl)
            passed = t if keep[-1] else passed
        if passed != known:
            if known is not None:
                self.handle.deleteTimer((known + self.ttl) // 1000)
            self.last.update((passed,))
            self.handle.registerTimer((passed + self.ttl) // 1000)
        kept = table["micros"][keep].tolist()
        yield pd.DataFrame({"dedup_key": pd.Series([key[0]] * len(kept), dtype=object), "micros": pd.Series(kept, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_exact(stream: DataFrame, key: str, ts: str, ttl: int = DEDUP_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """(key, micros) of the accepted rows, exactly as the batch operator; needs the RocksDB state store.

    State of a key goes when the watermark, ``delay`` behind the newest row, passes its TTL.
    """
    rows = stream.withWatermark(ts, delay).select(F.col(ts), F.col(key).alias("dedup_key"), F.unix_micros(F.col(ts)).alias("micros"))
    return rows.groupBy("dedup_key").transformWithStateInPandas(
        statefulProcessor=TtlDedup(ttl), outputStructType="dedup_key string, micros long", outputMode="Append", timeMode="EventTime"
    )


class Snapshots:
    """The note table and its full-text index under ``root``, changed by batches.

    Notes lie in ``buckets`` partitions by the hash of the id. A batch writes the partitions of its
    notes again, under new names, and one segment of the index; a manifest names what is current. It
    is put in place last and by a rename, so a reader or a run that breaks off sees either the old
    or the new state. A batch number that was applied is not applied again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifests = Manifests(spark, f"{self.root}/table")

    def current(self) -> dict:
        return {"notes": {}, "batch": -1, "index": None} | self.manifests.current()[1]

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/{v}/bucket={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(NOTE).parquet(*paths) if paths else self.spark.createDataFrame([], NOTE)

    def notes(self) -> DataFrame:
        return self._read(self.current()["notes"])

    def index(self) -> PostingsIndex:
        """The index as the current state of the notes has it."""
        return PostingsIndex(self.spark, f"{self.root}/index", self.current()["index"] or 0)

    def write(self, gone: DataFrame, came: DataFrame, batch: int) -> None:
        """Takes the ids ``gone`` away and adds the notes ``came``, which no other note of the table has the ids of."""
        number, _ = self.manifests.current()
        state = self.current()
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        came, gone = written(came.select(NOTE_COLUMNS)), written(gone.select("id").distinct())
        touched = {str(r[0]) for r in came.select("id").unionByName(gone).select(bucket.alias("b")).distinct().collect()}  # at most one row a bucket
        kept = self._read({b: v for b, v in state["notes"].items() if b in touched}).join(gone, "id", "left_anti").select(NOTE_COLUMNS)
        folder = f"notes-{batch:012d}-{uuid.uuid4().hex[:8]}"
        kept.unionByName(came).withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        there = {b: folder for b in touched if exists(self.spark, f"{self.root}/{folder}/bucket={b}")}
        index = self.index().apply(came, gone)
        notes = {b: v for b, v in state["notes"].items() if b not in touched} | there
        self.manifests.publish(number + 1, {"notes": notes, "batch": batch, "index": index.number})

    def upsert_batch(self, now: Callable[[], tuple[str, str]]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: upserts each batch and keeps the index up."""

        def run(batch: DataFrame, batch_id: int) -> None:
            if batch_id <= self.current()["batch"]:
                return
            notes = self.notes()
            parts = upsert_parts(notes, batch, *now())
            top = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
            fresh = numbered(parts.fresh, ["arrival", "video_code", *TIES], top, "id")
            self.write(parts.before.select("id"), parts.after.select(NOTE_COLUMNS).unionByName(fresh.select(NOTE_COLUMNS)), batch_id)

        return run
