"""Subject areas of documents by anchored non-negative matrix factorisation.

The document-term matrix X is factored into W (document by component) and H (component by
term), both non-negative, under the Kullback-Leibler divergence. The first components are
anchored: each starts from the terms of the documents that carry its subject's hand label,
and W starts with most of its weight on a document's labels; further components start from
the terms of all documents and take up what belongs to no subject. Alternating
multiplicative updates of W and H then correct wrong labels. All documents, all labels and all
terms held by at least ``LEAST_DOCS`` documents are fitted: blocks of documents lie in the shared
folder with their rows of W; each round is one pass over them, in which every task updates its
rows of W and adds up its share of H. H is broadcast, as at most ``SLOTS`` x components numbers
whatever the corpus. (``fit`` can be asked for a sample; no query does.)

Every document is then folded in over its whole text: W is updated with H fixed, and the
weights tell for each term which component it speaks for. A sentence is about the subject
that most of its subject terms speak for; headings are no sentences. A document has each
subject that at least ``share`` of its sentences are about.

Terms are words of alphabetic scripts and pairs of neighbouring characters of Chinese
script, hashed to ``SLOTS`` slots.

Defined cases: null, empty and wordless texts have no subject; unknown, null and repeated
labels are dropped, letter case is ignored; without any label nothing has a subject. Rows that
share an id are documents of their own, each with the id's labels.
"""

from __future__ import annotations

import functools
import gc
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import codes as C
from marginalia.operators.bounded import bounded_side
from marginalia.operators.shared import delete_folder, new_folder, written

SLOTS = 1 << 17
#: Of a sampled fit: documents without a label for each labelled one.
OTHERS = 1.375
BACKGROUND = 12
ROUNDS = 16
FOLD_ROUNDS = 6
#: Updates of each sentence's own row of W, which starts from its document's.
SENTENCE_ROUNDS = 2
#: Least number of documents that hold a term of the model.
LEAST_DOCS = 3
#: Terms as which a longer document weighs in the fit.
DOC_TERMS = 400
#: Of a sampled fit: counts (of a term in a document) at most.
MAX_COUNTS = 20_000_000
#: Of ``factor``: counts of whole documents that are updated together, which bounds its memory.
BLOCK_COUNTS = 50_000
#: Documents and counts from which a block of the fit is full; it is computed as a dense matrix of its documents and the terms that several of them hold.
DENSE_DOCS, DENSE_COUNTS = 128, 24_000
#: Letters of texts that are handled together, which keeps them in the processor's cache.
PORTION_LETTERS = 250_000
#: Counts from among whose documents those of a block are chosen.
PORTION = 1_000_000
#: Updated blocks whose shares of H are added up in single precision.
EXACT_BLOCKS = 1_024
#: Bytes of a row group of the blocks' files.
ROW_GROUP = 16 << 20
#: Bytes of the tasks' sums up to which they come to the driver as they are.
SUMS_BYTES = 100_000_000
#: Labelled documents up to which the labels are broadcast.
LABELLED = 1_000_000
#: Weight of subject terms from which a sentence is about the subject.
SENTENCE_WEIGHT = 0.9

_HAN = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_STOPS = "。！？!?；;\n\r…"
#: Bits of a character in ``_table``, above its lower case.
_LOW, _LETTER, _CHINESE, _STOP = (1 << 24) - 1, 1 << 24, 1 << 25, 1 << 26
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _first_powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * PORTION_LETTERS, base, np.uint64)]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    first = _first_powers(int(base))
    if n <= len(first):
        return first[:n]
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def _marked(codes: np.ndarray) -> np.ndarray:
    kind, low = C.classify(codes)
    marks = low.astype(np.uint32) | np.where(kind == 1, np.uint32(_LETTER), np.uint32(0))
    for a, b in _HAN:
        marks[(codes >= a) & (codes <= b)] |= np.uint32(_CHINESE)
    return marks


@functools.cache
def _table() -> np.ndarray:
    table = _marked(np.arange(C.BMP, dtype=np.uint32))
    table[[ord(c) for c in _STOPS]] |= np.uint32(_STOP)
    return table


def marked(codes: np.ndarray) -> np.ndarray:
    """The lower case of each code point, with the bits of letters, Chinese script and stops."""
    far = codes >= C.BMP
    if not far.any():
        return _table()[codes]
    marks = _table()[np.where(far, 0, codes)]
    marks[far] = _marked(codes[far])
    return marks


def terms(codes: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot, position) of every term of the texts' code points, by position."""
    marks = marked(codes) if marks is None else marks
    low = marks & np.uint32(_LOW)
    han = (marks & np.uint32(_CHINESE)) != 0
    word = np.zeros(len(codes) + 2, bool)
    np.equal(marks & np.uint32(_LETTER | _CHINESE), np.uint32(_LETTER), out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        # a word's hash: the difference of running sums of code * B**i, moved back by B**-start
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((low + np.uint64(1)) * _powers(_B, len(codes)), out=sums[1:])
        words = C.mix((sums[ends] - sums[starts]) * _powers(_BI, len(codes) + 1)[starts])
        pair = np.flatnonzero(han[:-1] & han[1:]) if len(han) > 1 else np.zeros(0, np.int64)
        pairs = C.mix(low[pair].astype(np.uint64) * _B + low[pair + 1].astype(np.uint64) + np.uint64(0x10000000))
    if not len(pair):
        return (words & np.uint64(SLOTS - 1)).astype(np.int64), starts
    at = np.concatenate([starts, pair])
    slot = (np.concatenate([words, pairs]) & np.uint64(SLOTS - 1)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return slot[order], at[order]


def sentence_ends(codes: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """True at the last character of a sentence: stops, line ends, and full stops before a blank."""
    stop = ((marked(codes) if marks is None else marks) & np.uint32(_STOP)) != 0
    dot = np.flatnonzero(codes == ord("."))
    after = np.minimum(dot + 1, len(codes) - 1)
    stop[dot[np.isin(codes[after], np.array([9, 10, 13, 32, 0x3000], np.uint32)) | (dot == len(codes) - 1)]] = True
    return stop


# ---------------------------------------------------------------- fitting


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in C.portions(batch):
            code, at = C.joined(texts)
            slot, place = terms(code)
            key, n = np.unique((np.searchsorted(at, place, "right") - 1) * SLOTS + slot, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[key // SLOTS]), pa.array((key % SLOTS).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["doc", "slot", "n"],
            )


def _first_w(seeds: np.ndarray, background: int) -> np.ndarray:
    """W at the start: most of a document's weight is on its labels."""
    start = np.where(seeds.any(1, keepdims=True), 0.02 + seeds, 0.1)
    w = np.concatenate([start, np.full((len(seeds), background), 1.0)], axis=1).astype(np.float32)
    return w / w.sum(1, keepdims=True)


def _next_w(new: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    w = new + 0.02 * new.sum(1, keepdims=True) * labelled + 1e-6
    return w / w.sum(1, keepdims=True)


def _first_h(total: np.ndarray, own: np.ndarray, background: int) -> np.ndarray:
    """H at the start, from each term's weight in all documents and in those of each subject.

    Anchors are terms that a subject's documents use more than all documents do.
    """
    rng = np.random.default_rng(20240229)
    terms_, subjects = own.shape
    h = np.empty((terms_, subjects + background), np.float32)
    for j in range(subjects):
        rate, base = own[:, j] / max(own[:, j].sum(), 1e-9), total / total.sum()
        h[:, j] = rate * np.maximum(rate / base - 1, 0) + 1e-9
    for j in range(background):
        h[:, subjects + j] = total / total.sum() * rng.uniform(0.9, 1.1, terms_)
    return h / h.sum(0, keepdims=True)


def factor(doc: np.ndarray, slot: np.ndarray, n: np.ndarray, seeds: np.ndarray, background: int = BACKGROUND, rounds: int = ROUNDS) -> np.ndarray:
    """H (slot by component) of counts in memory; ``seeds``: document by subject, 1 where labelled.

    Alternating multiplicative updates for the Kullback-Leibler divergence.
    """
    docs, subjects = seeds.shape
    k = subjects + background
    n = n.astype(np.float32)
    w = _first_w(seeds, background)
    used = np.flatnonzero(np.bincount(slot, minlength=SLOTS))
    at = np.zeros(SLOTS, np.int32)
    at[used] = np.arange(len(used))
    at = at[slot]
    total = np.bincount(at, n, len(used)) + 1e-9
    sure = seeds / np.maximum(seeds.sum(1, keepdims=True), 1)
    h = _first_h(total, np.stack([np.bincount(at, n * sure[doc, j], len(used)) for j in range(subjects)], axis=1), background)
    blocks = []
    first = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
    wanted = np.searchsorted(first, np.arange(0, len(doc), BLOCK_COUNTS))  # whole documents only
    edges = np.unique(np.concatenate([first[wanted[wanted < len(first)]], [0, len(doc)]]).astype(np.int64))
    for x, y in zip(edges, edges[1:]):
        order = np.argsort(at[x:y], kind="stable").astype(np.int32)
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], at[x:y][order]])))
        starts = np.flatnonzero(np.diff(np.concatenate([[-1], doc[x:y]])))
        blocks.append((x, y, order, cuts, starts))
    labelled = np.concatenate([seeds, np.zeros((docs, background))], axis=1).astype(np.float32)
    for _ in range(rounds):
        new_w, new_h = np.zeros_like(w), np.zeros_like(h)
        for x, y, order, cuts, starts in blocks:
            d, t = doc[x:y], at[x:y]
            part = w[d] * h[t]
            part *= (n[x:y] / (part.sum(1) + 1e-12))[:, None]
            new_w[d[starts]] = np.add.reduceat(part, starts, axis=0)
            new_h[t[order[cuts]]] += np.add.reduceat(part[order], cuts, axis=0)
        w = _next_w(new_w, labelled)
        h = new_h + 1e-7
        h /= h.sum(0, keepdims=True)
    out = np.zeros((SLOTS, k), np.float32)
    out[used] = h
    return out


@functools.cache
def _settled() -> None:
    """Takes what a worker has loaded out of the search for unreachable objects that Spark makes after each task, which costs more than many a task."""
    gc.collect()
    gc.freeze()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots, by size, and their counts of every document with terms; at last, how many documents hold each slot, and all documents."""
    _settled()
    held = np.zeros(SLOTS + 1)

    def column(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32))])

    for batch in batches:
        for ids, texts in C.portions(batch, PORTION_LETTERS):
            code, at = C.joined(texts)
            slot, place = terms(code)
            key, n = np.unique((np.searchsorted(at, place, "right") - 1) * SLOTS + slot, return_counts=True)
            row, first = np.unique(key // SLOTS, return_index=True)
            slot, edges = key % SLOTS, np.append(first, len(key))
            held[:SLOTS] += np.bincount(slot, minlength=SLOTS)
            held[SLOTS] += len(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[row]), column(slot, edges), column(n, edges), pa.nulls(len(row), pa.binary())], names=["doc", "slots", "n", "sums"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([held.tobytes()], pa.binary())], names=["doc", "slots", "n", "sums"])


_BLOCKS = "block binary, size long, w binary, sums binary"


def _rows(blocks: pa.Array, sizes: pa.Array, w: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([blocks, sizes, pa.array(w, pa.binary()), pa.nulls(len(w), pa.binary())], names=["block", "size", "w", "sums"])


def _sums_row(sums: np.ndarray) -> pa.RecordBatch:
    own = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, sums.nbytes], np.int32)), pa.py_buffer(sums)])
    columns = [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), own]
    return pa.RecordBatch.from_arrays(columns, names=["block", "size", "w", "sums"])


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(integers of all rows, offsets) of a column of their bytes."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(column.buffers()[2], np.int32)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _alike(row: np.ndarray, t: np.ndarray, rows: int, terms_: int) -> np.ndarray:
    """An order of documents in which neighbours share terms: along the main axis of co-occurrence, by two power iterations."""
    size, held = np.maximum(np.bincount(row, minlength=rows), 1), np.bincount(t, minlength=terms_) + 1e-9
    axis = np.random.default_rng(20240229).standard_normal(rows)
    for _ in range(2):
        axis -= (axis * size).sum() / size.sum()
        axis = np.bincount(row, (np.bincount(t, axis[row], terms_) / held)[t], rows) / size
    return np.argsort(axis, kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch], at: np.ndarray, subjects: int, background: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents with their first rows of W; at last each term's weight in all documents and in those of each subject.

    A block is the terms that several of its documents hold, their counts with the places in the matrix
    of documents and terms (both as differences, which are small numbers), the terms of one document
    alone with how many each document has and their counts, and the weight and labels of each document.
    Few terms make a dense matrix, so documents that share terms come together.
    """
    _settled()
    sums = np.zeros((at.max() + 1, 1 + subjects))
    held, number = np.zeros(len(sums), bool), np.zeros(len(sums), np.int32)

    def add(t: np.ndarray, n: np.ndarray, row: np.ndarray, scale: np.ndarray, seeds: np.ndarray) -> None:
        sums[:, 0] += np.bincount(t, n * scale[row], len(sums))
        weight = scale / np.maximum(seeds.sum(1), 1)
        some = np.flatnonzero(seeds.any(1)[row])
        t, n, row = t[some], n[some], row[some]
        for j in np.flatnonzero(seeds.any(0)):
            own = np.flatnonzero(seeds[row, j])
            sums[:, 1 + j] += np.bincount(t[own], n[own] * weight[row[own]], len(sums))

    def block(t: np.ndarray, n: np.ndarray, doc: np.ndarray, scale: np.ndarray, seeds: np.ndarray) -> tuple[bytes, int, bytes]:
        held[t] = True
        used = np.flatnonzero(held)
        held[used] = False
        number[used] = np.arange(len(used))
        once = np.bincount(number[t]) == 1
        number[used] = np.where(once, -1, np.cumsum(~once) - 1)
        used, local = used[~once], number[t]
        many = np.flatnonzero(local >= 0)
        steps = np.diff(doc[many] * len(used) + local[many], prepend=0)
        once = np.flatnonzero(local < 0)
        numbers = np.diff(used, prepend=0), steps, n[many], t[once], np.bincount(doc[once], minlength=len(seeds)), n[once]
        raw = pickle.dumps((*(x.astype(np.min_scalar_type(x.max(initial=0))) for x in numbers), scale, seeds), 5)
        return pa.compress(raw, "zstd", asbytes=True), len(raw), _first_w(seeds, background).tobytes()

    for batch in batches:
        (slots, offsets), (counts, _), labels = _ints(batch.column(1)), _ints(batch.column(2)), batch.column(3).to_pylist()
        cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, offsets[-1], PORTION)), len(labels)))
        for a, b in zip(cuts, cuts[1:]):
            t, n = at[slots[offsets[a] : offsets[b]]], counts[offsets[a] : offsets[b]]
            row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            scale = np.minimum(1, DOC_TERMS / np.maximum(np.bincount(row, n, b - a), 1)).astype(np.float32)  # a long document weighs as ``DOC_TERMS`` terms
            seeds = np.zeros((b - a, subjects), np.uint8)
            for i, own in enumerate(labels[a:b]):
                seeds[i, own or []] = 1
            some = np.flatnonzero(t >= 0)
            t, n, row = t[some], n[some], row[some]
            add(t, n, row, scale, seeds)
            order = _alike(row, t, b - a, len(sums))
            place = np.empty(b - a, np.int64)
            place[order] = np.arange(b - a)
            row = place[row]
            by = np.argsort(row * len(sums) + t)
            t, n, row = t[by], n[by], row[by]
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=b - a)))
            made, x = [], 0
            while x < b - a:
                y = min(x + DENSE_DOCS, max(x + 1, int(np.searchsorted(ends, ends[x] + DENSE_COUNTS))), b - a)
                if ends[y] > ends[x]:
                    made.append(block(t[ends[x] : ends[y]], n[ends[x] : ends[y]], row[ends[x] : ends[y]] - x, scale[order[x:y]], seeds[order[x:y]]))
                x = y
            if made:
                packed, sizes, w = zip(*made)
                yield _rows(pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), list(w))
    yield _sums_row(sums)


def _updated(batches: Iterator[pa.RecordBatch], h: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """The blocks with their rows of W updated, which nothing needs after the ``last`` update; at last what H is multiplied by."""
    _settled()
    sums, part, since = None, np.zeros(h.shape, np.float32), 0

    def update(packed: pa.Buffer, size: int, w: pa.Buffer) -> bytes:
        used, steps, n, once, each, times, scale, seeds = pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))
        used, place = np.cumsum(used, dtype=np.int64), np.cumsum(steps, dtype=np.int64)
        w = np.frombuffer(w, np.float32).reshape(len(seeds), -1)
        own = h.take(used, axis=0)
        rest = np.zeros(len(seeds) * len(used), np.float32)
        rest[place] = n / ((w @ own.T).ravel().take(place) + np.float32(1e-12))
        rest = rest.reshape(len(seeds), -1)
        weighed = w * scale[:, None]
        share = rest.T @ weighed
        share += part.take(used, axis=0)
        part[used] = share
        single = h.take(once, axis=0)
        times = times / (np.einsum("ij,ij->i", single, np.repeat(w, each, axis=0)) + np.float32(1e-12))
        share = np.repeat(weighed, each, axis=0)
        share *= times[:, None]
        share += part.take(once, axis=0)
        part[once] = share
        if last:
            return b""
        own = rest @ own
        single *= times[:, None]
        some = np.flatnonzero(each)
        own[some] += np.add.reduceat(single, (np.cumsum(each, dtype=np.int64) - each)[some], axis=0)
        labelled = np.zeros_like(w)
        labelled[:, : seeds.shape[1]] = seeds
        return _next_w(weighed * own, labelled).tobytes()

    for batch in batches:
        for start in range(0, batch.num_rows, C.SLICE_ROWS):
            blocks, sizes, w = batch.slice(start, C.SLICE_ROWS).columns
            new = [update(x.as_buffer(), size, y.as_buffer()) for x, size, y in zip(blocks, sizes.to_pylist(), w)]
            since += len(new)
            if since >= EXACT_BLOCKS:  # single precision is exact enough for some blocks only
                sums = part.astype(np.float64) if sums is None else sums + part
                part[:] = 0
                since = 0
            if not last:
                yield _rows(blocks, sizes, new)
    yield _sums_row(part if sums is None else (sums + part).astype(np.float32))


def _stored(df: DataFrame, compression: str) -> tuple[DataFrame, str]:
    """``df`` as files, and their folder."""
    folder = new_folder(df.sparkSession, "subjects")
    # a row group is held in memory where it is written and where it is read
    df.write.options(**{"compression": compression, "parquet.enable.dictionary": "false", "parquet.block.size": ROW_GROUP}).parquet(f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows"), folder


def _summed(df: DataFrame, kind: type, size: int, few: bool = True) -> np.ndarray:
    """The sum of the tasks' ``sums`` of ``size`` numbers; those of many tasks or bytes are added up where they are read before they come to the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_buffer(), kind).astype(np.float64) for batch in batches for x in batch.column(0)), np.zeros(1))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["sums"])

    parts = df.select("sums").where("sums IS NOT NULL")
    if not few or size * np.dtype(kind).itemsize * _tasks(df) > SUMS_BYTES:
        parts = parts.coalesce(4).mapInArrow(added, "sums binary")
    total = np.zeros(size)
    for x in parts.toArrow()["sums"]:
        own = np.frombuffer(x.as_buffer(), kind)
        if len(own) == size:  # of a task without rows: one zero
            total += own
    return total


def _known(labels: DataFrame, key: str, label: str, subjects: list[str]) -> DataFrame:
    return labels.select(F.col(key).cast("long").alias("doc"), F.lower(F.trim(F.col(label))).alias("s")).where(F.col("s").isin(*[s.lower() for s in subjects]) & F.col("doc").isNotNull())


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, subjects: list[str], sample: int | None = None) -> np.ndarray:
    """H from all documents and labels; if asked, from a sample of them (see ``_fit_sample``)."""
    none = np.zeros((SLOTS, len(subjects) + BACKGROUND), np.float32)
    known = _known(labels, key, label, subjects)
    if not subjects or known.isEmpty():
        return none
    if sample is not None:
        return _fit_sample(docs, key, text, known, subjects, sample)
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).where("doc IS NOT NULL AND t IS NOT NULL")
    counts, folder = _stored(texts.mapInArrow(_documents, "doc long, slots binary, n binary, sums binary"), "snappy")
    held = _summed(counts, np.float64, SLOTS + 1, few=False)
    used = np.flatnonzero(held[:-1] >= min(LEAST_DOCS, max(1, held[-1] // 20)))
    if not len(used):
        delete_folder(spark, folder)
        return none
    common = np.argsort(-held[used], kind="stable")  # frequent terms lie together, which is faster
    at = np.full(SLOTS, -1, np.int32)
    at[used[common]] = np.arange(len(used))
    number = F.array_position(F.array(*[F.lit(s.lower()) for s in subjects]), F.col("s")) - 1
    own, _ = bounded_side(known.groupBy("doc").agg(F.sort_array(F.collect_set(number.cast("int"))).alias("own")), LABELLED)
    rows = counts.where("doc IS NOT NULL").select("doc", "slots", "n").join(own, "doc", "left")
    model = spark.sparkContext.broadcast(at)
    blocks, new = _stored(_few(rows).mapInArrow(lambda b: _blocks(b, model.value, len(subjects), BACKGROUND), _BLOCKS), "uncompressed")
    delete_folder(spark, folder)
    model.destroy()
    sums = _summed(blocks, np.float64, len(used) * (1 + len(subjects))).reshape(-1, 1 + len(subjects))
    h = np.empty((len(used), len(subjects) + BACKGROUND), np.float32)
    sums = sums[at[used]]
    h[at[used]] = _first_h(sums[:, 0] + 1e-9, sums[:, 1:], BACKGROUND)
    for i in range(ROUNDS if sums[:, 1:].any() else 0):
        model, folder = spark.sparkContext.broadcast(h), new
        rows = blocks.where("block IS NOT NULL").select("block", "size", "w")
        blocks, new = _stored(_few(rows).mapInArrow(lambda b, last=i == ROUNDS - 1: _updated(b, model.value, last), _BLOCKS), "uncompressed")
        delete_folder(spark, folder)
        h = (h * _summed(blocks, np.float32, h.size).reshape(h.shape) + 1e-7).astype(np.float32)
        h /= h.sum(0, keepdims=True)
        model.destroy()
    delete_folder(spark, new)
    if sums[:, 1:].any():
        none[used] = h[at[used]]
    return none


def _tasks(rows: DataFrame) -> int:
    """As many as keep all cores busy."""
    return rows.sparkSession.sparkContext.defaultParallelism


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` in few partitions, as each gives a sum of its own."""
    return rows.coalesce(_tasks(rows))


def _fit_sample(docs: DataFrame, key: str, text: str, known: DataFrame, subjects: list[str], sample: int) -> np.ndarray:
    """H from at most ``sample`` labelled documents and ``OTHERS`` times as many without a label, on the driver."""
    labelled = known.groupBy("doc").agg(F.sort_array(F.collect_set("s")).alias("s")).orderBy(F.xxhash64("doc"), "doc").limit(sample)
    rows = labelled.collect()  # at most ``sample``
    spark, ids = docs.sparkSession, [(r[0],) for r in rows]
    others = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc")).where("doc IS NOT NULL")
    others = others.join(known.select("doc").distinct(), "doc", "left_anti")
    ids += [(r[0],) for r in others.orderBy(F.xxhash64("doc"), "doc").limit(int(OTHERS * len(rows))).collect()]
    chosen = spark.createDataFrame(ids, "doc long").distinct()
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "doc")
    counts = written(texts.mapInArrow(_counts, "doc long, slot int, n int"))
    # very long documents may hold more terms than the driver can: then the first ones in the order of their hashes
    sizes = counts.groupBy("doc").agg(F.count("*").alias("size")).orderBy(F.xxhash64("doc", F.lit(2)), "doc").collect()  # at most (1 + OTHERS) x sample
    fitting = [r["doc"] for r, total in zip(sizes, itertools.accumulate(r["size"] for r in sizes)) if total <= MAX_COUNTS]
    if len(fitting) < len(sizes):
        counts = counts.where(F.col("doc").isin(fitting))
    got = counts.toArrow()
    ids, doc = np.unique(got["doc"].to_numpy(), return_inverse=True)
    pair, n = doc * SLOTS + got["slot"].to_numpy(), got["n"].to_numpy()
    del got, doc
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    del order
    first = np.flatnonzero(np.diff(pair, prepend=-1))  # of the rows of a document and slot: ids may repeat
    n = np.add.reduceat(n, first) if len(first) else n
    pair = pair[first]
    doc, slot = (pair // SLOTS).astype(np.int32), (pair % SLOTS).astype(np.int32)
    del pair, first
    place = {i: p for p, i in enumerate(ids.tolist())}
    seeds = np.zeros((len(ids), len(subjects)), np.float32)
    at = {s.lower(): j for j, s in enumerate(subjects)}
    for i, names in rows:
        if i in place:
            for s in names:
                seeds[place[i], at[s]] = 1
    # a long document weighs as ``DOC_TERMS`` terms
    n = (n * np.minimum(1, DOC_TERMS / np.bincount(doc, n))[doc]).astype(np.float32)
    often = np.bincount(slot, minlength=SLOTS)[slot] >= min(LEAST_DOCS, max(1, len(ids) // 20))
    doc, slot, n = doc[often], slot[often], n[often]
    return factor(doc, slot, n, seeds)


def informative(h: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each slot or -1, rows): the terms that speak for some subject more than for the background."""
    total = h.sum(1)
    best = h[:, :subjects].max(1) / np.maximum(total, 1e-12)
    keep = np.flatnonzero((total > 0) & (best > 0.25))
    row = np.full(SLOTS, -1, np.int32)
    row[keep] = np.arange(len(keep))
    return row, h[keep]


# ---------------------------------------------------------------- folding in


def _folded(h: np.ndarray, row: np.ndarray, first: np.ndarray, w: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of W, their terms by component) after ``rounds`` updates of ``w`` with H fixed.

    ``row``: of H, of each term; ``first``: where the terms of each row of W begin. Rows of W with about as
    many terms are updated together, filled up with the last row of H, which is zero.
    """
    width = np.diff(first, append=len(row))
    order = np.argsort(width, kind="stable")
    sizes = width[order]
    new, terms_of = np.empty_like(w), np.empty_like(w)
    x = 0
    while x < len(order):
        y = int(np.searchsorted(sizes, max(sizes[x] * 5 // 4, sizes[x] + 1), "right"))
        some, steps = order[x:y], np.arange(sizes[y - 1])
        at = np.minimum(first[some, None] + steps, len(row) - 1)
        part = h[np.where(steps < sizes[x:y, None], row[at], len(h) - 1)]
        own = w[some]
        for _ in range(rounds):
            rest = 1 / (np.matmul(part, own[:, :, None]) + np.float32(1e-20))
            got = own * np.matmul(rest.transpose(0, 2, 1), part)[:, 0]
            own = got + np.float32(0.05)
            own /= own.sum(1, keepdims=True)
        new[some], terms_of[some] = own, got
        x = y
    return new, terms_of


def _mixtures(batches: Iterator[pa.RecordBatch], row_of: np.ndarray, h: np.ndarray, subjects: list[str], share: float) -> Iterator[pa.RecordBatch]:
    _settled()
    s = len(subjects)
    h = np.concatenate([h, np.zeros((1, h.shape[1]), np.float32)])
    for batch in batches:
        for ids, texts in C.portions(batch, PORTION_LETTERS):
            code, at = C.joined(texts)
            if not len(code) or len(h) == 1:
                continue
            marks = marked(code)
            ends = sentence_ends(code, marks)
            ends[at[1:][at[1:] > 0] - 1] = True
            number = np.zeros(len(code), np.int32)  # of the sentence of each character
            np.cumsum(ends[:-1], dtype=np.int32, out=number[1:])
            slot, place = terms(code, marks)
            # sentences: pieces with at least one letter that are no headings
            begin = np.append(0, np.flatnonzero(ends[:-1]) + 1)
            has = np.logical_or.reduceat((marks & np.uint32(_LETTER)) != 0, begin) & (code[begin] != ord("#"))
            doc_of = np.searchsorted(at, begin, "right") - 1
            row = row_of[slot]
            known = np.flatnonzero(row >= 0)
            row, sent = row[known], number[place[known]]
            known = has[sent]
            row, sent = row[known], sent[known]
            if not len(row):
                continue
            doc = doc_of[sent]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            w, _ = _folded(h, row, first, np.full((len(first), h.shape[1]), 1 / h.shape[1], np.float32), FOLD_ROUNDS)
            # every sentence is a row of W of its own, from its document's
            cut = np.flatnonzero(np.diff(sent, prepend=-1))
            _, terms_of = _folded(h, row, cut, w[np.searchsorted(first, cut, "right") - 1], SENTENCE_ROUNDS)
            weight = terms_of[:, :s]
            best = weight.argmax(1)
            sure = weight[np.arange(len(best)), best] >= SENTENCE_WEIGHT
            about = np.bincount(doc_of[sent[cut]][sure] * s + best[sure], minlength=len(ids) * s).reshape(len(ids), s)
            count = np.bincount(doc_of[has], minlength=len(ids))
            d, j = np.nonzero((about > 0) & (about >= share * count[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[d]), pa.array([subjects[x] for x in j.tolist()], pa.string()), pa.array(about[d, j] / count[d])],
                names=["doc_id", "subject", "share"],
            )


def subjects_of(docs: DataFrame, key: str, text: str, h: np.ndarray, subjects: list[str], share: float = 0.25) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least ``share`` of a document's sentences are about."""
    model = docs.sparkSession.sparkContext.broadcast(informative(h, len(subjects)))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return texts.mapInArrow(lambda b: _mixtures(b, *model.value, subjects, share), "doc_id long, subject string, share double")
