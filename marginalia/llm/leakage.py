"""Evaluation passages inside documents, by winnowing.

Both sides are reduced to their letters in lower case. Of every window of ``w`` successive
k-gram hashes the least one is a fingerprint, so two texts that share a stretch of at least
w + k - 1 letters share a fingerprint inside it. A document and an item that share one are a
candidate. A hit is then extended to all stretches of at least w + k - 1 letters that both
hold: a letter of the item lies in such a stretch if and only if some run of w + k - 1 letters
over it is among the document's runs of that length. An item has leaked if those letters are
enough of it. The work for a candidate is the length of its two texts, however often a
fingerprint repeats in them.

The items are the stated query set. Up to ``BLOCK_LETTERS`` characters of them are indexed
and broadcast, and the documents are never shuffled. Beyond, the fingerprints of both sides are
joined by a shuffle, in one scan of the documents, and the texts of candidates after them.

Defined cases: null texts have no letters; items shorter than their stretch length can't
leak, nor can items without one; items with equal texts leak together; a document is given once
for each item, however often the passage occurs in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import codes as C
from marginalia.operators.shared import written

BLOCK_LETTERS = 4_000_000
#: Letters of a document that are hashed at a time; slices overlap, so no stretch is lost.
SLICE = 2_000_000


def fingerprints(code: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): every position whose hash is the least of some window (ties: all of them).

    Texts with fewer than ``w`` k-grams have none.
    """
    h = C.kgrams(code, k)
    if len(h) < w:
        return h[:0], np.zeros(0, np.int64)
    least = C.sliding_min(h, w)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(C.sliding_max(np.concatenate([pad, least, pad]), w) == h)
    return h[at], at


class ItemIndex:
    """Fingerprints and runs of a block of items that share the stretch length ``stretch``."""

    def __init__(self, ids: list[int], texts: list[str], stretch: int):
        self.stretch, self.k = stretch, (stretch + 1) // 2
        self.w = stretch - self.k + 1
        self.ids = ids
        code, self.at = C.kept(texts, (1,))
        at, self.letters = self.at, np.diff(self.at)
        runs = C.kgrams(code, stretch)
        place = np.arange(len(runs))
        place = place[place + stretch <= at[np.searchsorted(at, place, "right")]] if len(runs) else place  # inside one item
        order = np.argsort(runs[place], kind="stable")
        self.run, self.place = runs[place][order], place[order]
        hashes = [np.unique(fingerprints(code[a:b], self.k, self.w)[0]) for a, b in zip(at, at[1:])]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], owner[order]

    def candidates(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (document, item) that share a fingerprint, by document; ``at``: offsets of the documents."""
        found = [np.zeros(0, np.int64)]
        step = max(SLICE, 4 * self.stretch)
        for start in range(0, len(code) if len(self.hash) else 0, step):
            h, p = fingerprints(code[start : start + step + self.stretch], self.k, self.w)
            left = np.searchsorted(self.hash, h, "left")
            near = self.hash[np.minimum(left, len(self.hash) - 1)] == h
            h, p, left = h[near], p[near] + start, left[near]
            doc = np.searchsorted(at, p, "right") - 1
            inside = p + self.k <= at[doc + 1]
            if inside.any():
                width = len(self.hash) + 1
                pairs, first = np.unique(doc[inside] * width + left[inside], return_index=True)  # a fingerprint once a document
                doc, left = pairs // width, pairs % width
                n = np.searchsorted(self.hash, h[inside][first], "right") - left
                item = self.owner[_expanded(left, n)]
                found.append(np.unique(np.repeat(doc, n) * len(self.ids) + item))
        pairs = np.unique(np.concatenate(found))
        return np.stack([pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))], axis=1)

    def shared(self, code: np.ndarray) -> np.ndarray:
        """How many letters of each item lie in stretches that the document ``code`` has."""
        found = [np.zeros(0, np.int64)]
        for start in range(0, len(code), SLICE):
            own = np.sort(C.kgrams(code[start : start + SLICE + self.stretch - 1], self.stretch))
            own = own[np.diff(own, prepend=own[:1] + np.uint64(1)) != 0]
            left = np.searchsorted(self.run, own, "left")
            hit = self.run[np.minimum(left, len(self.run) - 1)] == own if len(self.run) else np.zeros(len(own), bool)
            left = left[hit]
            found.append(self.place[_expanded(left, np.searchsorted(self.run, own[hit], "right") - left)])
        place = np.unique(np.concatenate(found))
        # a run ends inside its item, so the next item's runs never shorten it
        added = np.minimum(self.stretch, np.diff(place, append=1 << 62))
        return np.bincount(np.searchsorted(self.at, place, "right") - 1, added, len(self.ids)).astype(np.int64)


def _expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``n`` from each ``start``."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


_LEAKS = "doc_id long, item_id long, shared_letters long, item_letters long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "shared_letters", "item_letters"])


def _leaks(batches: Iterator[pa.RecordBatch], indexes: list[ItemIndex], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in C.portions(batch):
            code, at = C.kept(texts, (1,))
            rows: list[tuple] = []
            for index in indexes:
                pairs = index.candidates(code, at)
                cuts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else []
                for a, b in zip(cuts, [*cuts[1:], len(pairs)]):
                    d, items = int(pairs[a, 0]), pairs[a:b, 1]
                    for i, n in zip(items.tolist(), index.shared(code[at[d] : at[d + 1]])[items].tolist()):
                        if n * share[1] >= share[0] * index.letters[i]:
                            rows.append((ids[d], index.ids[i], n, int(index.letters[i])))
            yield _rows(rows)


def _prints(batches: Iterator[pa.RecordBatch], stretches: list[int]) -> Iterator[pa.RecordBatch]:
    """(id, stretch, hash): the distinct fingerprints of every text for each stretch length, or for its own (a third column)."""
    for batch in batches:
        for row in C.slices(batch):
            for j, (i, t) in enumerate(zip(row[0], row[1])):
                code, _ = C.kept([t], (1,))
                for n in [row[2][j]] if len(row) > 2 else stretches:
                    k = (n + 1) // 2
                    step = max(SLICE, 4 * n)
                    parts = [fingerprints(code[x : x + step + n], k, n - k + 1)[0] for x in range(0, len(code), step)]
                    h = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], names=["id", "stretch", "hash"])


def _extended(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Leaks among candidates (doc_id, item_id, stretch, text, item text)."""
    for batch in batches:
        rows = []
        for d, i, n, text, passage in (r for x in C.slices(batch, 16) for r in zip(*x)):
            index = ItemIndex([i], [passage], n)
            got = int(index.shared(C.kept([text], (1,))[0])[0])
            if got * share[1] >= share[0] * index.letters[0]:
                rows.append((d, i, got, int(index.letters[0])))
        yield _rows(rows)


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, stretch: str, share: tuple[int, int] = (2, 5), block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(doc_id, item_id, shared_letters, item_letters) of the items whose shared stretches cover ``share`` of their letters.

    ``stretch``: the column of ``items`` with the least length of a stretch.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    known = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("p"), F.col(stretch).cast("int").alias("n"))
    # an item needs as many letters as a stretch has; so many characters at least can be told here
    known = known.where((F.col("item").isNotNull()) & (F.col("n") > 0) & (F.length("p") >= F.col("n")))
    if (known.agg(F.sum(F.length("p"))).first()[0] or 0) <= block_letters:
        block = known.orderBy("item", "p").collect()  # at most ``block_letters`` characters
        indexes = [ItemIndex([r[0] for r in block if r[2] == n], [r[1] for r in block if r[2] == n], n) for n in sorted({r[2] for r in block})]
        sent = spark.sparkContext.broadcast(indexes)
        found = texts.mapInArrow(lambda b: _leaks(b, sent.value, share), _LEAKS)
    else:
        lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # lengths of stretches: a parameter a language, few
        schema = "id long, stretch int, hash long"
        ours = texts.mapInArrow(lambda b: _prints(b, lengths), schema)
        theirs = known.select("item", "p", "n").mapInArrow(lambda b: _prints(b, []), schema).withColumnRenamed("id", "item_id")
        pairs = written(ours.join(theirs, ["stretch", "hash"]).select("id", "item_id", "stretch").distinct())
        pairs = pairs.join(known.select(F.col("item").alias("item_id"), "p", F.col("n").alias("stretch")), ["item_id", "stretch"])
        pairs = pairs.join(texts, "id").select(F.col("id").alias("doc_id"), "item_id", "stretch", "t", "p")
        found = pairs.mapInArrow(lambda b: _extended(b, share), _LEAKS)
    return found.groupBy("doc_id", "item_id").agg(F.max("shared_letters").alias("shared_letters"), F.max("item_letters").alias("item_letters"))
