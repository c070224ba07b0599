"""Texts of a batch as one array of code points, and hashes over it (numpy only)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BMP = 0x10000


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: 1 letter, 2 other letter-or-digit; and its lower case."""
    kind, lower = np.zeros(BMP, np.uint8), np.arange(BMP, dtype=np.uint32)
    for c in range(BMP):
        kind[c], lower[c] = _one(c)
    return kind, lower


def _one(c: int) -> tuple[int, int]:
    if 0xD800 <= c < 0xE000:
        return 0, c
    ch = chr(c)
    low = ch.lower()
    return (1 if ch.isalpha() else 2 if ch.isalnum() else 0), (ord(low) if len(low) == 1 else c)


def classify(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower-cased code) of each code point; kinds as in ``_tables``."""
    kind_of, lower_of = _tables()
    far = codes >= BMP
    if not far.any():
        return kind_of[codes], lower_of[codes]
    near = np.where(far, 0, codes)
    kind, lower = kind_of[near], lower_of[near]
    values, at = np.unique(codes[far], return_inverse=True)
    known = np.array([_one(int(v)) for v in values], dtype=np.uint32).reshape(-1, 2)
    kind[far], lower[far] = known[at, 0].astype(np.uint8), known[at, 1]
    return kind, lower


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def kept(texts: list[str], kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points of the given kinds only, offsets)."""
    codes, offsets = joined(texts)
    kind, lower = classify(codes)
    keep = np.isin(kind, kinds) if len(kinds) > 1 else kind == kinds[0]
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return lower[keep], before[offsets]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used alone."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def kgrams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` codes, in order; doubling the run, so log k passes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, width, run = _BASE, 1, mix(codes.astype(U64) + U64(1))
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if out is None:
                    out, done = run[: n + 0 if width == k else len(run)], width
                else:
                    size = len(codes) - done - width + 1
                    out, done = out[:size] * power + run[done : done + size], done + width
            if width * 2 > k:
                break
            run = run[: len(run) - width] * power + run[width:]
            power, width = power * power, width * 2
    return mix(out[:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w`` values, by doubling."""
    have, out = 1, h
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sliding_max(h: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, h
    while have * 2 <= w:
        out = np.maximum(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return np.maximum(out[: len(out) - rest], out[rest:]) if rest else out


#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 256


def columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """The columns of a batch as lists, ``rows`` rows at a time, so that long texts don't pile up."""
    for start in range(0, batch.num_rows, rows):
        yield columns(batch.slice(start, rows))


def portions(batch: pa.RecordBatch, limit: int = 1_000_000):
    """(ids, texts) of a batch of two columns without null texts, in portions of about ``limit`` characters."""
    a, b, size = [], [], 0
    for ids, texts in slices(batch):
        for i, t in zip(ids, texts):
            if t is None:
                continue
            a.append(i)
            b.append(t)
            size += len(t)
            if size >= limit:
                yield a, b
                a, b, size = [], [], 0
    if a:
        yield a, b
