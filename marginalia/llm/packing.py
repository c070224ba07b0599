"""Filling fixed-capacity containers: bounded-space online best fit.

Texts are sized in tokens once and hashed to lanes. A lane packs its texts one after the other,
in the order of a hash, into at most ``OPEN_BINS`` open containers. A bitset has a one for
every free space that some open container has; the container with the least free space that
still fits is found by shifting the bitset. If none fits and all places are taken, the fullest
container closes and a new one opens. A text over the capacity is cut into full containers and
its last piece is packed like any other.

With a ``window`` of one text that is the plain online order. A longer window is a bounded look
ahead: its texts are placed by falling size, which leaves less space unused.

Containers that are still open when a lane ends and have more than ``SPARE`` of their
capacity free go to a second round with ``MERGE`` times fewer lanes, and so on until one lane
is left; so what stays unused doesn't grow with the number of lanes. Lanes and orders depend
on the keys alone, so a task that is run again packs the same.

Defined cases: null texts and texts without tokens take no place; equal texts are packed
each; containers are numbered without gaps within their kind.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import codes as C
from marginalia.operators.shared import written

OPEN_BINS = 1024
#: Texts of a lane that are looked at together, the largest first.
WINDOW = 2000
LANE_TEXTS = 50_000
MERGE = 16
SPARE = 0.02
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """The path of a public tokenizer's vocabulary file, where the environment has them."""
    import os

    folder = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    return os.path.join(folder, name)


_ENCODERS: dict = {}
#: Characters handed to the encoder at a time; longer texts are cut at a blank or a line end.
PIECE_CHARS = 200_000


def _encoder(path: str):
    if path not in _ENCODERS:
        import base64
        import importlib.util
        import os

        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(os.path.dirname(path), "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: str, path: str) -> int:
    """Tokens of the whole text."""
    encode = _encoder(path).encode_ordinary
    if len(text) <= PIECE_CHARS:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        if end < len(text):
            cut = max(text.rfind("\n", at + 1, end), text.rfind(" ", at + 1, end))
            end = cut if cut > at else end
        total += len(encode(text[at:end]))
        at = end
    return total


def _sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [count_tokens(t, path) if t else 0 for _, texts in C.slices(batch) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "tokens"])


def sizes(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, tokens) of every text."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(lambda b: _sizes(b, path), "key long, tokens long")


class OpenBins:
    """At most ``limit`` open containers of ``capacity``; ``close(bin)`` receives the closed ones."""

    def __init__(self, capacity: int, limit: int, close):
        self.capacity, self.limit, self.close = capacity, limit, close
        self.bits, self.by_free, self.count = 0, {}, 0

    def _take(self, free: int) -> list:
        places = self.by_free[free]
        items = places.pop()
        if not places:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return items

    def _put(self, free: int, items: list) -> None:
        if not free:
            self.close(0, items)
            return
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.count += 1

    def add(self, size: int, items: list) -> None:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1  # the least free space that fits
            held = self._take(free)
            held += items
            self._put(free - size, held)
            return
        if self.count >= self.limit:
            fullest = (self.bits & -self.bits).bit_length() - 1
            self.close(fullest, self._take(fullest))
        self._put(self.capacity - size, list(items))

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.bits:
            free = (self.bits & -self.bits).bit_length() - 1
            yield free, self._take(free)


_PACKED = "kind string, lane int, bin long, closed boolean, free long, keys array<long>, starts array<long>, ends array<long>"
_PACKED_ARROW = pa.schema([
    ("kind", pa.string()), ("lane", pa.int32()), ("bin", pa.int64()), ("closed", pa.bool_()), ("free", pa.int64()),
    ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
])


def _send(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_PACKED_ARROW)], schema=_PACKED_ARROW)


def _lanes(groups: Iterator[tuple[int, Iterator[tuple]]], capacity: dict[str, int], open_bins: int, window: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Packs the items (kind or None for all, size, parts) of each lane."""
    rows: list[tuple] = []
    for lane, items in groups:
        number = dict.fromkeys(capacity, 0)

        def row(kind: str, closed: bool, free: int, parts: list) -> None:
            number[kind] += 1
            rows.append((kind, lane, number[kind], closed, free, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))

        bins = {k: OpenBins(c, open_bins, lambda free, parts, k=k: row(k, True, free, parts)) for k, c in capacity.items()}
        for ahead in itertools.batched(items, window):
            for k, c in capacity.items():
                pieces = []
                for kind, size, parts in ahead:
                    if kind is not None and kind != k:
                        continue
                    if size <= c:
                        pieces.append((size, parts))
                        continue
                    key = parts[0][0]  # only a single text can exceed the capacity
                    full = size // c * c
                    for s in range(0, full, c):
                        row(k, True, 0, [(key, s, s + c)])
                    if size > full:
                        pieces.append((size - full, [(key, full, size)]))
                for size, parts in sorted(pieces, key=lambda p: -p[0]):
                    bins[k].add(size, parts)
            if len(rows) > 2000:
                yield _send(rows)
                rows.clear()
        for k, b in bins.items():
            for free, parts in b.rest():
                row(k, last or free <= SPARE * capacity[k], free, parts)
    if rows:
        yield _send(rows)


def _first(batches: Iterator[pa.RecordBatch], capacity: dict[str, int], open_bins: int, window: int, last: bool) -> Iterator[pa.RecordBatch]:
    yield from _lanes(_by_lane((lane, (None, n, [(key, 0, n)])) for b in batches for lane, key, n in zip(*C.columns(b))), capacity, open_bins, window, last)


def _again(batches: Iterator[pa.RecordBatch], capacity: dict[str, int], open_bins: int, window: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Empties the bins that were left open into their items and packs them, largest bins first as they come."""

    def items() -> Iterator[tuple[int, tuple]]:
        for b in batches:
            for lane, kind, keys, starts, ends in zip(*C.columns(b)):
                for p in zip(keys, starts, ends):
                    yield lane, (kind, p[2] - p[1], [p])

    yield from _lanes(_by_lane(items()), capacity, open_bins, window, last)


def _by_lane(rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, Iterator[tuple]]]:
    for lane, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield lane, (r[1] for r in group)


def pack(sized: DataFrame, containers: list[tuple[str, int]], open_bins: int = OPEN_BINS, lane_texts: int = LANE_TEXTS, window: int = WINDOW) -> DataFrame:
    """(container_kind, container_no, key, ord, token_start, token_end, tokens_free) of all (key, tokens)."""
    capacity = {k: c for k, c in containers if k is not None and c is not None and c > 0}
    sized = written(sized.where("key IS NOT NULL AND tokens > 0"))
    lanes = max(1, math.ceil(sized.count() / lane_texts))
    lane = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = sized.select(lane("key", lanes).alias("lane"), "key", "tokens").repartition(lanes, "lane")
    spread = spread.sortWithinPartitions("lane", F.xxhash64("key", F.lit(1)), "key", "tokens")
    packed = written(spread.mapInArrow(lambda b, end=lanes == 1: _first(b, capacity, open_bins, window, end), _PACKED))
    done, level = packed.where("closed").withColumn("level", F.lit(0)), 0
    while lanes > 1:
        lanes, level = max(1, lanes // MERGE), level + 1
        left = packed.where("NOT closed").select((F.col("lane") % lanes).cast("int").alias("l"), "kind", "keys", "starts", "ends", "free", F.col("lane").alias("from"), "bin")
        left = left.repartition(lanes, "l").sortWithinPartitions("l", "kind", "from", "bin").select("l", "kind", "keys", "starts", "ends")
        packed = written(left.mapInArrow(lambda b, end=lanes == 1: _again(b, capacity, open_bins, window, end), _PACKED))
        done = done.unionByName(packed.where("closed").withColumn("level", F.lit(level)))
    # numbers without gaps: the containers of a (kind, level, lane) count from the sum of those before it
    n = done.groupBy("kind", "level", "lane").agg(F.max("bin").alias("top"), F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("level", "lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = done.join(before.select("kind", "level", "lane", "before"), ["kind", "level", "lane"])
    # within a lane, bins are numbered by closing; open ones that moved on left gaps
    w = Window.partitionBy("kind", "level", "lane").orderBy("bin")
    numbered = numbered.withColumn("no", F.col("before") + F.row_number().over(w))
    parts = numbered.select(F.col("kind").alias("container_kind"), F.col("no").cast("long").alias("container_no"), F.col("free").alias("tokens_free"), F.posexplode(F.arrays_zip("keys", "starts", "ends")).alias("i", "p"))
    return parts.select(
        "container_kind", "container_no", F.col("p.keys").alias("key"), (F.col("i") + 1).cast("long").alias("ord"),
        F.col("p.starts").alias("token_start"), F.col("p.ends").alias("token_end"), "tokens_free",
    )


def violations(packed: DataFrame, sized: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(rule, broken): how often a filling breaks each rule, all of them counted over all rows."""
    capacity = F.create_map(*[F.lit(x) for kv in containers for x in kv])
    length = F.col("token_end") - F.col("token_start")
    bins = packed.groupBy("container_kind", "container_no").agg(F.sum(length).alias("held"), F.max("tokens_free").alias("free"), F.count("*").alias("n"), F.max("ord").alias("last"))
    bins = bins.withColumn("c", F.try_element_at(capacity, F.col("container_kind")))
    kinds = bins.groupBy("container_kind").agg(F.count("*").alias("n"), F.max("container_no").alias("last"))
    texts = packed.groupBy("container_kind", "key").agg(F.sum(length).alias("held"), F.max("token_end").alias("end"), F.count("*").alias("parts"))
    texts = texts.withColumn("c", F.try_element_at(capacity, F.col("container_kind"))).join(sized.where("tokens > 0").select("key", "tokens"), "key", "full")
    count = lambda name, df, broken: df.agg(F.count_if(broken).alias("broken")).select(F.lit(name).alias("rule"), "broken")
    rules = [
        count("overfull", bins, F.col("held") > F.col("c")),
        count("free space wrong", bins, F.col("held") + F.col("free") != F.col("c")),
        count("orders with gaps", bins, F.col("n") != F.col("last")),
        count("numbers with gaps", kinds, F.col("n") != F.col("last")),
        count("text not whole", texts, F.coalesce((F.col("held") != F.col("tokens")) | (F.col("end") != F.col("tokens")), F.lit(True))),
        count("split without need", texts, (F.col("parts") > 1) & (F.col("tokens") <= F.col("c"))),
    ]
    return functools.reduce(DataFrame.unionByName, rules)
