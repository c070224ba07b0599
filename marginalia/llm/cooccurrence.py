"""Items that appear together, by stripes.

Each task keeps an associative array (a stripe) of neighbours for every item of its
records and merges as it reads; the stripe of an item holds the item itself (its record
count) and the items after it in code-point order. A stripe is cut into segments by the
hash of the neighbour, so that the merged segments of even the most frequent item stay
small, and equal (item, segment) keys are merged in one sorted pass that holds a single
segment at a time. Log-likelihood ratio and lift follow from the merged counts.

Defined cases: repeats of an item in a record count once; null, empty and one-item records
give no pair; a null item is no item; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.bounded import bounded_side
from marginalia.operators.shared import written

STRIPE = "item string, segment int, neighbours array<string>, counts array<long>"
_ARROW = pa.schema([("item", pa.string()), ("segment", pa.int32()), ("neighbours", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
#: Entries of the stripes that a task holds before it sends them on.
HELD_ENTRIES = 1_000_000
#: Segments of a stripe; a segment of an item with a million neighbours holds about 4,000.
SEGMENTS = 256
SEND_ROWS = 4096
#: Items whose own counts are broadcast to the pairs; more are joined by a shuffle.
MAX_BROADCAST_ITEMS = 100_000


def _batches(rows: Iterator[tuple[str, int, dict]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, dict]] = []

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in held], pa.string()),
                pa.array([r[1] for r in held], pa.int32()),
                pa.array([list(r[2]) for r in held], pa.list_(pa.string())),
                pa.array([list(r[2].values()) for r in held], pa.list_(pa.int64())),
            ],
            schema=_ARROW,
        )

    for row in rows:
        held.append(row)
        if len(held) == SEND_ROWS:
            yield send()
            held = []
    if held:
        yield send()


def _build(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Stripes of a task's records, merged while they are read."""
    import zlib

    stripes: dict[str, Counter] = defaultdict(Counter)

    def cut() -> Iterator[tuple[str, int, dict]]:
        for item, stripe in stripes.items():
            parts: dict[int, dict] = defaultdict(dict)
            for b, n in stripe.items():
                parts[0 if b == item else zlib.crc32(b.encode()) % segments][b] = n
            for segment, part in parts.items():
                yield item, segment, part

    entries = 0
    for batch in batches:
        for items in batch.column(0).to_pylist():
            for i, a in enumerate(items):
                stripe = stripes[a]
                before = len(stripe)
                stripe.update(items[i:])
                entries += len(stripe) - before
            if entries > HELD_ENTRIES:
                yield from _batches(cut())
                stripes.clear()
                entries = 0
    yield from _batches(cut())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the stripes of equal neighbours in the sort order; one segment in memory."""

    def rows() -> Iterator[tuple[str, int, dict]]:
        at, total = None, Counter()
        for batch in batches:
            for item, segment, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (item, segment) != at:
                    if at is not None:
                        yield *at, total
                    at, total = (item, segment), Counter()
                for k, n in zip(keys, counts):
                    total[k] += n
        if at is not None:
            yield *at, total

    yield from _batches(rows())


def stripes(records: DataFrame, items: str, segments: int = SEGMENTS) -> DataFrame:
    """Merged stripe segments (item, segment, neighbours, counts) of the array column ``items``."""
    clean = F.sort_array(F.array_distinct(F.filter(F.col(items), lambda t: t.isNotNull() & (t != ""))))
    arrays = records.select(clean.alias("items")).where(F.size("items") > 0)
    built = arrays.mapInArrow(lambda b: _build(b, segments), STRIPE)
    return built.repartition("item", "segment").sortWithinPartitions("item", "segment").mapInArrow(_merge, STRIPE)


def cooccurrence(records: DataFrame, items: str, n_records: int, min_count: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, lift, llr) of the pairs with n_ab >= ``min_count``; item_a < item_b."""
    pairs = stripes(records, items, segments).select("item", F.explode(F.arrays_zip("neighbours", "counts")).alias("e"))
    pairs = pairs.select("item", F.col("e.neighbours").alias("other"), F.col("e.counts").alias("n"))
    # the stripes are needed twice, for the pairs and for the items' own counts: written once, to the shared folder
    pairs = written(pairs.where(F.col("n") >= min_count))
    single, _ = bounded_side(pairs.where("item = other").select("item", "n"), MAX_BROADCAST_ITEMS)
    n_a = single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    n_b = single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    found = pairs.where("item != other").select(F.col("item").alias("item_a"), F.col("other").alias("item_b"), F.col("n").alias("n_ab"))
    found = found.join(n_a, "item_a").join(n_b, "item_b")
    n = F.lit(float(n_records))
    k11 = F.col("n_ab").cast("double")
    k12, k21 = F.col("n_a") - k11, F.col("n_b") - k11
    k22 = n - k11 - k12 - k21
    xlx = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))
    rows, cols = xlx(k11 + k12) + xlx(k21 + k22), xlx(k11 + k21) + xlx(k12 + k22)
    llr = F.lit(2.0) * (xlx(k11) + xlx(k12) + xlx(k21) + xlx(k22) + xlx(n) - rows - cols)
    return found.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", (k11 * n / F.col("n_a") / F.col("n_b")).alias("lift"), F.greatest(llr, F.lit(0.0)).alias("llr")
    )
