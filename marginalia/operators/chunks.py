"""Long messages in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import MARKDOWN_PART_BYTES, TEXT_PART_BYTES


def text_parts(text: str, limit: int = TEXT_PART_BYTES) -> list[str]:
    """Parts of at most ``limit`` UTF-8 bytes, cut behind the last line end of the second half if there is one.

    The first candidate cut is ``limit`` characters, so "half" is half of the characters that fit.
    """
    parts, start = [], 0
    while start < len(text):
        size, end = 0, start
        while end < len(text):
            ch = ord(text[end])
            step = 1 if ch < 0x80 else 2 if ch < 0x800 else 3 if ch < 0x10000 else 4
            if size + step > limit:
                break
            size, end = size + step, end + 1
        if end < len(text):
            if end == start:
                end = start + 1  # a limit under one character
            line = text.rfind("\n", start, end)
            if line - start > (end - start) // 2:
                end = line + 1
        parts.append(text[start:end])
        start = end
    return parts


def markdown_parts(text: str, limit: int = MARKDOWN_PART_BYTES) -> list[str]:
    """Whole lines packed up to ``limit`` bytes; a longer line is a part of its own. Every line ends with a newline."""
    parts: list[str] = []
    held, size = [], 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass")) + 1
        if held and size + n > limit:
            parts.append("".join(held))
            held, size = [], 0
        held.append(line + "\n")
        size += n
    return [*parts, "".join(held)]


def _explode(batches: Iterator[pa.RecordBatch], f: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = (c.to_pylist() for c in batch.columns)
        rows = [(k, i + 1, len(parts), p) for k, t in zip(keys, texts) if t is not None for parts in [f(t)] for i, p in enumerate(parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], batch.schema[0].type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())],
            names=["key", "part_no", "n_parts", "part"],
        )


def as_sent(parts: DataFrame) -> DataFrame:
    """``chunked`` texts with their number before every part but the first."""
    number = F.concat(F.lit("["), F.col("part_no"), F.lit("/"), F.col("n_parts"), F.lit("]\n"))
    return parts.withColumn("part", F.when(F.col("part_no") > 1, F.concat(number, "part")).otherwise(F.col("part")))


def chunked(df: DataFrame, key: str, text: str, markdown: bool = False) -> DataFrame:
    """(key, part_no, n_parts, part) of every text; null texts have no parts."""
    kind = df.schema[key].dataType.simpleString()
    f = markdown_parts if markdown else text_parts
    return df.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(lambda b: _explode(b, f), f"key {kind}, part_no int, n_parts int, part string")
