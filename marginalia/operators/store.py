"""The note store as DataFrames: lookups, lists, statistics, upsert and delete.

Order is by ``created_at`` as text, newest first, and by the larger id among equals; null
``created_at`` comes last. Limits must not be negative.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.bounded import bounded_side
from marginalia.operators.like import has
from marginalia.operators.shared import written
from marginalia.schema import LIST_COLUMNS, NOTE_COLUMNS


def newest() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def _limit(n: int) -> int:
    if n < 0:
        raise ValueError("limits and offsets must not be negative")
    return n


@dataclass(frozen=True)
class NoteStore:
    """Notes and the name of the place where they are stored."""

    notes: DataFrame
    location: str = ""

    def get_by_id(self, note_id: int) -> DataFrame:
        return self.notes.where(F.col("id") == note_id).limit(1)

    def get_by_code(self, code: str) -> DataFrame:
        return self.notes.where(F.col("video_code") == code).limit(1)

    def get_by_video_id(self, video_id: str) -> DataFrame:
        """The newest note of a video."""
        return self.notes.where(F.col("video_id") == video_id).orderBy(*newest()).limit(1)

    def by_title_and_author(self, title: str, author: str) -> DataFrame:
        return self.notes.where((F.col("title") == title) & (F.col("author") == author)).orderBy(*newest())

    def list_recent(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return self.notes.select(LIST_COLUMNS).orderBy(*newest()).offset(_limit(offset)).limit(_limit(limit))

    def list_by_tag(self, tag: str, limit: int = 20) -> DataFrame:
        return self.notes.where(has(F.col("tags"), tag)).select(LIST_COLUMNS).orderBy(*newest()).limit(_limit(limit))

    def stats(self) -> DataFrame:
        """(total_entries, latest_entry, store): one row, also of no notes."""
        return self.notes.agg(F.count("*").alias("total_entries"), F.max("created_at").alias("latest_entry"), F.lit(self.location).alias("store"))

    def delete(self, ids: DataFrame) -> DataFrame:
        """The notes without those whose id is in ``ids``."""
        known, _ = bounded_side(ids.select("id").where("id IS NOT NULL").distinct(), MAX_BROADCAST_KEYS)
        return self.notes.join(known, "id", "left_anti").select(NOTE_COLUMNS)

    def delete_by_code(self, codes: DataFrame) -> DataFrame:
        known, _ = bounded_side(codes.select("video_code").where("video_code IS NOT NULL").distinct(), MAX_BROADCAST_KEYS)
        return self.notes.join(known, "video_code", "left_anti").select(NOTE_COLUMNS)

    def duplicates(self, incoming: DataFrame) -> DataFrame:
        """``incoming`` (title, author, ...) with the code of the newest note of the same title and author, or null."""
        latest = self.notes.where("title IS NOT NULL AND author IS NOT NULL").groupBy("title", "author").agg(
            F.max_by(F.struct("id", "video_code"), F.struct(F.coalesce("created_at", F.lit("")), "id")).alias("last")
        )
        return incoming.join(latest, ["title", "author"], "left").select(
            *incoming.columns, F.col("last.id").alias("duplicate_id"), F.col("last.video_code").alias("duplicate_code")
        )


#: Keys that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 500_000
#: Columns that a later row of the same code overwrites; the others keep their first values.
OVERWRITTEN = ["title", "author", "summary_markdown", "tags", "user_requirement", "created_at", "timestamp"]
KEPT = ["video_id", "source_url", "duration_seconds"]
TIES = ["created_at", "title", "author", "summary_markdown", "tags", "user_requirement", "video_id", "source_url"]


def numbered(df: DataFrame, order: list[str], start: Column | int, out: str) -> DataFrame:
    """Consecutive numbers in the order of ``order``, without one task that sees all rows.

    The rows are written once, range-partitioned and sorted; each part adds the sizes of the
    parts before it.
    """
    parts = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    parts = written(parts.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    return parts.join(before, "__part").withColumn(out, (F.lit(start) + F.col("__before") + within).cast("long")).drop("__part", "__at", "__before")


@dataclass(frozen=True)
class Upserted:
    """What a batch does to the notes: those it leaves, those it meets before and after, and the new ones, which have no id yet."""

    untouched: DataFrame
    before: DataFrame
    after: DataFrame
    fresh: DataFrame


def upsert_parts(notes: DataFrame, batch: DataFrame, now: str, stamp: str) -> Upserted:
    """The parts of ``upsert``; only notes whose code the batch has are touched, found by the batch's codes."""
    rows = batch.withColumn("created_at", F.coalesce(F.nullif("created_at", F.lit("")), F.lit(now))).withColumn("timestamp", F.lit(stamp))
    order = F.struct("arrival", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TIES])
    coded = rows.where("video_code IS NOT NULL").groupBy("video_code").agg(
        F.max_by(F.struct(*OVERWRITTEN), order).alias("last"), F.min_by(F.struct(*KEPT), order).alias("first"), F.min("arrival").alias("arrival")
    )
    # the notes whose codes the batch doesn't have stay where they are: only codes are broadcast, no text is shuffled
    codes, _ = bounded_side(coded.select("video_code"), MAX_BROADCAST_KEYS)
    untouched = notes.join(codes, "video_code", "left_anti")
    touched = notes.join(codes, "video_code", "left_semi")
    merged = touched.join(coded.select("video_code", "last"), "video_code").select("id", "video_code", *KEPT, *[F.col(f"last.{c}").alias(c) for c in OVERWRITTEN])
    fresh = coded.join(touched.select("video_code"), "video_code", "left_anti").select("arrival", "video_code", "first.*", "last.*")
    nameless = rows.where("video_code IS NULL").select("arrival", "video_code", *KEPT, *OVERWRITTEN)
    return Upserted(untouched, touched, merged, fresh.unionByName(nameless))


def upsert(notes: DataFrame, batch: DataFrame, now: str, stamp: str) -> DataFrame:
    """``notes`` after a batch of (columns of a note without id, arrival).

    Rows of a code arrive in the order of ``arrival``: the first inserts or meets the stored
    note, every later one overwrites seven columns. A null code never meets another; the
    empty code does. An empty ``created_at`` becomes ``now``, ``timestamp`` is always ``stamp``.
    New ids follow the largest one in order of first arrival.
    """
    parts = upsert_parts(notes, batch, now, stamp)
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = numbered(parts.fresh, ["arrival", "video_code", *TIES], top, "id")
    return parts.untouched.select(NOTE_COLUMNS).unionByName(parts.after.select(NOTE_COLUMNS)).unionByName(new.select(NOTE_COLUMNS))


def video_code(key: Column, length: int = 5) -> Column:
    """A code of ``length`` characters of [0-9a-z] from a key: the same key gives the same code."""
    h = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("long"), F.lit(36**length))
    return F.lower(F.lpad(F.conv(h.cast("string"), 10, 36), length, "0"))


def code_collisions(df: DataFrame, code: str) -> DataFrame:
    """(code, n) of the codes that more than one row has."""
    return df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n")).where("n > 1")
