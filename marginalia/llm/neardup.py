"""Near-duplicate texts: BK-trees over Hamming distance, one tree for each shard.

Every text is reduced to its letters and digits in lower case and cut into distinct
five-character pieces, and MinHash values are taken over the pieces. Two texts of Jaccard
similarity J agree in one value with probability J.

Shards are the bands of the signature: texts that agree in the ``ROWS`` values of a band share
a shard. Inside a shard a text has a sketch of ``BITS`` bits, one of each of as many values of
other bands, whose expected distance is ``BITS`` * (1 - J) / 2. The sketches form a BK-tree: the
children of a node are keyed by their integer Hamming distance to it, and a search follows only
edges within ``RADIUS`` of its own distance. The sketch is short and the radius small, so a search
leaves out most of the tree (``Forest.visits`` counts), which it can't at the radius that a long
sketch would need. A pair of similarity J is found by a band with probability
J**ROWS * P(Binomial(BITS, (1 - J) / 2) <= RADIUS), and misses all ``BANDS`` of them at J = 0.6 with
about 0.5 %. Candidates are first compared by signatures of four bits a value, and those that
remain by all their pieces.

One tree over everything, broadcast, would grow with the data; a shard's tree is built where the
shard was sent, and only bounded lists of ids are broadcast.

No shard is held whole. One with over ``TREE_SIZE`` texts is split by a second band: of three
segments of the sketch two sketches within the radius of 2 agree in at least one, so every text
goes to the three sub-shards of its segments and no pair is lost. Tasks notice hot shards
while they hash: beyond ``HOT`` texts of one shard a task sends the others to the sub-shards at once,
and a mark that makes the rest follow. So a shard that holds a third of all texts costs each task
``HOT`` rows at the shard's own key.

Texts of the same letters and digits are one class with the smallest id as its representative,
dropped within each task before the shuffle, so a text that fills a third of the table costs
one row a task.

Defined cases: null texts and texts of fewer than five letters and digits are in no pair;
an empty table gives no rows; repeated rows of one id count as one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import codes as C
from marginalia.operators.bounded import bounded_side
from marginalia.operators.shared import stored, written

PIECE = 5
BANDS, ROWS = 68, 3
BITS, RADIUS = 16, 2
#: (shift, width) of the sketch's segments, one more than the radius.
SEGMENTS = ((0, 5), (5, 5), (10, 6))
#: Texts of a shard that are searched without a second band.
TREE_SIZE = 2000
#: Texts of one shard that a task sends to the shard itself.
HOT = 256
#: Standard deviations by which a signature may fall short of the threshold.
SLACK = 3.5
#: Byte-identical copies up to this number are written out as pairs; of more, every copy is
#: paired with the first, which alone stands for them.
EXPANDED = 256
#: Representatives whose texts are found by a broadcast; beyond it the table is shuffled once by its ids.
MAX_BROADCAST_IDS = 500_000
SEEN = 1_000_000

HASHES = BANDS * ROWS
_A = (C.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
#: Values whose bits make the sketch of each band, none of the band's own.
_OF_SKETCH = (np.arange(BANDS)[:, None] * ROWS + ROWS + 11 * np.arange(BITS)) % HASHES
#: Kinds of rows; as the top two bits of a signed number they sort as SPLIT, SIGNATURE, MARK, OWN.
MARK, OWN, SPLIT, SIGNATURE = 0, 1, 2, 3


def pieces_of(text: str) -> np.ndarray:
    """Sorted distinct piece hashes of a text."""
    return _piece_sets([text])[0]


def _hash_text(code: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(code.tobytes()) - (1 << 63)


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, texts in C.portions(batch):
            code, at = C.kept(texts, (1, 2))
            yield ids, texts, code, at


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for ids, texts, code, at in _normal(batches):
        got = [(i, _hash_text(code[a:b]), xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)) for i, t, a, b in zip(ids, texts, at, at[1:]) if b - a >= PIECE]
        yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(3)], names=["id", "class", "copy"])


def minima(h: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over the pieces of one text, whatever its length."""
    step = 4096
    out = (_A[:, None] * h[None, :step]).min(axis=1)
    for i in range(step, len(h), step):
        np.minimum(out, (_A[:, None] * h[None, i : i + step]).min(axis=1), out=out)
    return out


def shards_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shards, sketches, signatures) of rows of MinHash values: two numbers for each band, and bytes."""
    bands = values.astype(np.uint64).reshape(len(values), BANDS, ROWS)
    with np.errstate(over="ignore"):
        shard = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(7), bands.shape[:2])
        for r in range(ROWS):
            shard = C.mix(shard * C._BASE + bands[:, :, r])
        mixed = C.mix(values.astype(np.uint64))
    bit = (mixed & np.uint64(1)).astype(np.int64)
    sketch = (bit[:, _OF_SKETCH] << np.arange(BITS)).sum(axis=2)
    nibble = ((mixed >> np.uint64(8)) & np.uint64(15)).astype(np.uint8)
    return shard.view(np.int64), sketch, nibble[:, ::2] << 4 | nibble[:, 1::2]


def sub_shards(shard: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The sub-shards of each text, one for each segment of its sketch."""
    with np.errstate(over="ignore"):
        own = np.stack([(sketch >> at) & ((1 << width) - 1) | i << BITS for i, (at, width) in enumerate(SEGMENTS)], axis=1).astype(np.uint64)
        return C.mix(shard.view(np.uint64)[:, None] * C._BASE + own + np.uint64(1)).view(np.int64)


_SHARDS = "key long, class long, signature binary"
_SHARDS_ARROW = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("signature", pa.binary())])
_SHARD_BITS = 62 - BITS


def encoded(kind: int, shard: np.ndarray, sketch: np.ndarray | int) -> np.ndarray:
    """Kind, shard and sketch in one number: rows sort by kind and shard, and one number sorts fastest."""
    low = (shard.view(np.uint64) & np.uint64((1 << _SHARD_BITS) - 1)) << np.uint64(BITS) | np.asarray(sketch).astype(np.uint64)
    return (low | np.uint64(kind << 62)).view(np.int64)


def decoded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, shard, sketch) of encoded keys."""
    shard = key >> BITS & ((1 << _SHARD_BITS) - 1)
    return key >> 62 & 3, shard, key & ((1 << BITS) - 1)


def _rows(parts: list[tuple[np.ndarray, np.ndarray]], signatures: list[bytes], classes: np.ndarray) -> pa.RecordBatch:
    """Rows of (key, class) without a signature, and a row with the signature of each class."""
    none = sum(len(p[0]) for p in parts)
    key = np.concatenate([*(p[0] for p in parts), encoded(SIGNATURE, classes, 0)])
    cls = np.concatenate([*(p[1] for p in parts), classes])
    signature = pa.concat_arrays([pa.nulls(none, pa.binary()), pa.array(signatures, pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), signature], schema=_SHARDS_ARROW)


def _bands(batches: Iterator[pa.RecordBatch], hot: int = HOT) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    marked: set[int] = set()
    counts = np.zeros(1 << 20, np.uint32)  # texts of this task by the low bits of their shards
    for _, _, code, at in _normal(batches):
        grams = (C.kgrams(code, PIECE) >> np.uint64(32)).astype(np.uint32)
        classes, rows = [], []
        for a, b in zip(at, at[1:]):
            if b - a < PIECE:
                continue
            k = _hash_text(code[a:b])
            if k in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(k)
            classes.append(k)
            rows.append(minima(grams[a : b - PIECE + 1]))
        if not classes:
            continue
        shard, sketch, signature = shards_of(np.array(rows))
        own = np.array(classes, np.int64)
        key, sketch, cls = shard.ravel(), sketch.ravel(), np.repeat(own, BANDS)
        slot, place, n = np.unique(key & np.int64(len(counts) - 1), return_inverse=True, return_counts=True)
        counts[slot] += n.astype(np.uint32)
        over = (counts[slot] > hot)[place]
        parts = [(encoded(OWN, key[~over], sketch[~over]), cls[~over])]
        if over.any():
            new = np.array([k for k in np.unique(key[over]).tolist() if k not in marked], np.int64)
            marked.update(new.tolist())
            parts += [(encoded(MARK, new, 0), np.zeros(len(new), np.int64)), _split(key[over], sketch[over], cls[over])]
        yield _rows(parts, [x.tobytes() for x in signature], own)


def _split(shard: np.ndarray, sketch: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, class) in the sub-shards; of a shard only the bits that keys hold count."""
    n = len(SEGMENTS)
    return encoded(SPLIT, sub_shards(shard & ((1 << _SHARD_BITS) - 1), sketch).ravel(), np.repeat(sketch, n)), np.repeat(cls, n)


class Forest:
    """The BK-trees of several shards in arrays.

    A node is a distinct sketch of a shard; ``parent`` and ``edge`` (the distance to the parent) make the trees.
    """

    def __init__(self, shard: np.ndarray, sketch: np.ndarray, cls: np.ndarray):
        # in a shard by a permutation of the sketches, so that roots aren't the smallest ones
        mixed = (sketch * 40503) & ((1 << BITS) - 1)
        order = np.lexsort((cls, mixed, shard))
        shard, sketch, cls = shard[order], sketch[order], cls[order]
        again = np.zeros(len(shard), bool)  # a class of several tasks
        again[1:] = (shard[1:] == shard[:-1]) & (cls[1:] == cls[:-1])
        shard, sketch, self.cls = shard[~again], sketch[~again], cls[~again]
        first = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (sketch[1:] != sketch[:-1])]) if len(shard) else np.zeros(0, np.int64)
        self.start, self.end = first, np.r_[first[1:], len(shard)]
        self.sketch = sketch[first]
        tree = shard[first]
        roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else first
        self.root = np.repeat(roots, np.diff(np.r_[roots, len(tree)]))
        self.visits = 0
        self._grow()

    def _grow(self) -> None:
        """All trees level by level: the first of the nodes at one edge of a parent becomes its child, the others go below it."""
        n = len(self.sketch)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        while len(rest):
            d = np.bitwise_count(self.sketch[rest] ^ self.sketch[at]).astype(np.int64)
            key = at * 64 + d
            order = np.argsort(key, kind="stable")
            k = key[order]
            head = np.r_[True, k[1:] != k[:-1]]
            child = rest[order[head]]
            self.parent[child], self.edge[child] = at[order[head]], d[order[head]]
            below = child[np.cumsum(head) - 1]
            rest, at = rest[order[~head]], below[~head]
            order = np.argsort(rest, kind="stable")
            rest, at = rest[order], at[order]
        key = np.where(self.parent < 0, -1, self.parent * 64 + self.edge)
        self.child = np.argsort(key, kind="stable")
        self.key = key[self.child]

    def within(self, radius: int, queries: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (node, earlier node or itself) of one shard within the radius, some queries at a time."""
        for start in range(0, len(self.sketch), queries):
            q = np.arange(start, min(len(self.sketch), start + queries))
            x = self.root[q]
            while len(q):
                self.visits += len(q)
                d = np.bitwise_count(self.sketch[q] ^ self.sketch[x]).astype(np.int64)
                near = (d <= radius) & (x <= q)
                yield q[near], x[near]
                low = np.searchsorted(self.key, x * 64 + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.key, x * 64 + d + radius, "right") - low
                x = self.child[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                q = np.repeat(q, n)

    def pairs(self, radius: int, most: int = 500_000) -> Iterator[np.ndarray]:
        """Arrays of (a, b), a < b: the classes of close nodes, and those of one node; at most about ``most`` rows each."""
        for q, x in self.within(radius):
            rows = (self.end[q] - self.start[q]) * (self.end[x] - self.start[x])
            part = np.cumsum(rows) // most
            for p in np.unique(part):
                yield from self._product(q[part == p], x[part == p], most)

    def _product(self, q: np.ndarray, x: np.ndarray, most: int) -> Iterator[np.ndarray]:
        left, right = self.end[q] - self.start[q], self.end[x] - self.start[x]
        node = np.repeat(np.arange(len(q)), left)
        member = np.arange(len(node)) - np.repeat(np.cumsum(left) - left, left) + self.start[q][node]
        n = right[node]
        step = max(1, most // max(1, int(n.max(initial=1))))
        for i in range(0, len(node), step):
            j, k = node[i : i + step], n[i : i + step]
            a = np.repeat(member[i : i + step], k)
            b = np.repeat(self.start[x][j], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            once = np.repeat(q[j] != x[j], k) | (b < a)
            a, b = self.cls[a[once]], self.cls[b[once]]
            if len(a):
                yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


_FOUND = "kind int, a long, b long, signature binary"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("signature", pa.binary())])


def _found(kind: int, a: np.ndarray, b: np.ndarray, signature=None) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.nulls(n, pa.binary()) if signature is None else signature]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)


def _search(batches: Iterator[pa.RecordBatch], radius: int, tree_size: int | None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind ``OWN``: classes) of the shards in the sort order.

    Rows of shards that are marked or hold more than ``tree_size`` texts leave as rows of their
    sub-shards (kind ``SPLIT``: key, class), and so do rows that came as such; signatures pass once a class.
    Without a ``tree_size`` the rows are those of sub-shards, which are searched whatever their size.
    """
    wanted = SPLIT if tree_size is None else OWN
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    marks, size, signed = np.zeros(0, np.int64), 0, None
    pairs: list[np.ndarray] = []

    def close(final: bool) -> Iterator[pa.RecordBatch]:
        if pairs and (final or sum(map(len, pairs)) > 200_000):
            got = np.unique(np.concatenate(pairs), axis=0)
            pairs.clear()
            yield _found(OWN, got[:, 0], got[:, 1])

    def work(shard: np.ndarray, sketch: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(shard):
            return
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        n = np.diff(np.r_[starts, len(shard)])
        large = np.isin(shard[starts], marks)
        if tree_size is not None:
            large |= n > tree_size
        large, several = np.repeat(large, n), np.repeat(n > 1, n)
        if large.any():
            yield _found(SPLIT, *_split(shard[large], sketch[large], cls[large]))
        own = several & ~large
        if own.any():
            for got in Forest(shard[own], sketch[own], cls[own]).pairs(radius):
                pairs.append(got)
                yield from close(False)

    for batch in batches:
        key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        kind, shard, sketch = decoded(key)
        passing = kind == SPLIT
        if wanted == OWN and passing.any():
            yield _found(SPLIT, key[passing], cls[passing])
        at = np.flatnonzero(kind == SIGNATURE)
        if len(at):
            new = np.r_[cls[at[0]] != signed, cls[at[1:]] != cls[at[:-1]]]
            signed = cls[at[-1]]
            if new.any():
                yield _found(SIGNATURE, cls[at[new]], cls[at[new]], batch.column(2).take(pa.array(at[new])))
        marks = np.concatenate([marks, shard[kind == MARK]])  # they sort before the rows of shards
        rows = kind == wanted
        if not rows.any():
            continue
        held.append((shard[rows], sketch[rows], cls[rows]))
        size += len(held[-1][0])
        last = held[-1][0][-1]
        if held[0][0][0] == last and (tree_size is None or size <= tree_size):
            continue  # all of one shard so far
        k, s, c = (np.concatenate([h[i] for h in held]) for i in range(3))
        stays = k == last
        if tree_size is not None and stays.sum() > tree_size:
            marks = np.append(marks, last)  # the rest of a large shard follows row by row
            stays[:] = False
        yield from work(k[~stays], s[~stays], c[~stays])
        held, size = [(k[stays], s[stays], c[stays])] if stays.any() else [], int(stays.sum())
    if held:
        yield from work(*(np.concatenate([h[i] for h in held]) for i in range(3)))
    yield from close(True)


def _alike(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures don't rule out the threshold."""
    agree = threshold + (1 - threshold) / 16
    least = agree - SLACK * (agree * (1 - agree) / HASHES) ** 0.5
    for batch in batches:
        for start in range(0, batch.num_rows, 10_000):
            part = batch.slice(start, 10_000)
            x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (2, 3))
            differ = x ^ y
            same = ((differ & 15 == 0).sum(axis=1, dtype=np.int64) + (differ >> 4 == 0).sum(axis=1, dtype=np.int64)) / HASHES
            yield part.select([0, 1]).filter(pa.array(same >= least))


def _piece_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct piece hashes of every text."""
    code, at = C.kept(texts, (1, 2))
    grams = C.kgrams(code, PIECE)
    return [np.unique(grams[a : max(a, b - PIECE + 1)]) for a, b in zip(at.tolist(), at[1:].tolist())]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            a, b, ta, tb = C.columns(batch.slice(start, 512))
            text = dict(zip(a, ta)) | dict(zip(b, tb))
            pieces = dict(zip(text, _piece_sets(list(text.values()))))
            out = []
            for x, y in zip(a, b):
                p, q = pieces[x], pieces[y]
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                out.append(both / (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class, copy) of every text with at least one piece: hashes of its letters and digits, and of the text as it is."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(_members, "id long, class long, copy long")


def candidates(df: DataFrame, key: str, text: str, threshold: float, radius: int = RADIUS, tree_size: int = TREE_SIZE, hot: int = HOT) -> DataFrame:
    """Distinct (a, b), a < b: pairs of classes that are close in some shard's tree and by their signatures."""
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    shards = texts.mapInArrow(lambda b: _bands(b, hot), _SHARDS)
    place = F.shiftrightunsigned("key", BITS).bitwiseAND(F.lit((1 << _SHARD_BITS) - 1))
    found = shards.repartition(place).sortWithinPartitions("key").mapInArrow(lambda b: _search(b, radius, tree_size), _FOUND)
    found = written(found)  # pairs are few against the shards; signatures are read twice
    pairs = found.where(F.col("kind") == OWN).select("a", "b")
    split = found.where(F.col("kind") == SPLIT).select(F.col("a").alias("key"), F.col("b").alias("class"), F.lit(None).cast("binary").alias("signature"))
    if split.limit(1).count():
        again = split.repartition(place).sortWithinPartitions("key").mapInArrow(lambda b: _search(b, radius, None), _FOUND)
        pairs = pairs.unionByName(again.select("a", "b"))
    signed = found.where(F.col("kind") == SIGNATURE)
    x, y = (signed.select(F.col("a").alias(k), F.col("signature").alias(f"s{k}")) for k in "ab")
    return pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(lambda b: _alike(b, threshold), "a long, b long")


def similar_classes(df: DataFrame, key: str, text: str, threshold: float, classes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b, similarity) of the pairs of different classes at or above the threshold.

    ``classes``: (class, rep, n) with the representative's id.
    """
    close = written(candidates(df, key, text, threshold, radius, tree_size))
    needed = close.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class").select(F.col("rep").alias("id"), "class")
    side, _ = bounded_side(needed, MAX_BROADCAST_IDS)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(side, "id").select("class", "t")
    pairs = close.join(texts.select(F.col("class").alias("a"), F.col("t").alias("ta")), "a")
    pairs = pairs.join(texts.select(F.col("class").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    return pairs.mapInArrow(_compare, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(membership, links).

    membership: (id, class, copy, rep, n), the class of each text, the hash of the text as it is,
    the smallest id of the class and its size; links: (rep_a, rep_b, similarity) between the
    representatives of different classes, rep_a < rep_b. Together they tell every pair.
    """
    of = written(members(df, key, text).distinct())
    classes = written(of.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    links = similar_classes(df, key, text, threshold, classes, radius, tree_size)
    a, b = classes.select(F.col("class").alias("a"), F.col("rep").alias("ra")), classes.select(F.col("class").alias("b"), F.col("rep").alias("rb"))
    links = links.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"), "similarity")
    several, _ = bounded_side(classes.where("n > 1"), MAX_BROADCAST_IDS)
    membership = of.join(several.withColumnRenamed("class", "c"), F.col("class") == F.col("c"), "left").select(
        "id", "class", "copy", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1).cast("long")).alias("n")
    )
    return membership, links


def as_pairs(membership: DataFrame, links: DataFrame, expanded: int = EXPANDED) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all notes of one class, and all notes of linked classes.

    Only where more than ``expanded`` notes have byte for byte the same text, the first of them
    stands for all in these pairs and each other one is paired with it.
    """
    # a class of n notes has no text more than n times, so only large ones are looked at
    large = membership.where(F.col("n") > expanded)
    copied = large.groupBy("class", "copy").agg(F.min("id").alias("first"), F.count("*").alias("m")).where(F.col("m") > expanded)
    copied = copied.select(F.col("class").alias("c"), F.col("copy").alias("p"), "first")
    held = large.join(copied, (F.col("class") == F.col("c")) & (F.col("copy") == F.col("p")), "left").select("id", "rep", "first")
    held = held.unionByName(membership.where((F.col("n") > 1) & (F.col("n") <= expanded)).select("id", "rep", F.lit(None).cast("long").alias("first")))
    held = written(held)
    several = held.where("first IS NULL OR first = id").select("rep", "id")
    same = several.alias("x").join(several.alias("y"), "rep").where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    to_first = held.where("first != id").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    grown = links.join(several.select(F.col("rep").alias("rep_a"), F.col("id").alias("ia")), "rep_a", "left")
    grown = grown.join(several.select(F.col("rep").alias("rep_b"), F.col("id").alias("ib")), "rep_b", "left")
    a, b = F.coalesce("ia", "rep_a"), F.coalesce("ib", "rep_b")
    between = grown.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
    return between.unionByName(same).unionByName(to_first)


def _roots(parent: DataFrame, max_rounds: int) -> DataFrame:
    """(rep, root) of a forest of (rep, root), root <= rep, in which every root is a rep: parents by pointer jumping."""
    for _ in range(max_rounds):
        up = parent.select(F.col("rep").alias("at"), F.col("root").alias("further"))
        jumped = parent.join(up, F.col("root") == F.col("at")).select("rep", F.col("root").alias("old"), F.col("further").alias("root"))
        jumped = stored(jumped, "parents")
        parent = jumped.select("rep", "root")
        if not jumped.where("old != root").limit(1).count():
            return parent
    raise RuntimeError(f"parents have not settled after {max_rounds} rounds")


def groups(membership: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, group_id, links): the connected group of every text, named by its smallest id, and the links of its class.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the
    parents to the roots by pointer jumping and keeps only the links between different roots,
    until none is left. Nodes that stay have only hooked neighbours, and those that no
    neighbour chose have a smaller root next to them in the next round: two rounds leave at
    most one root for each hooked node and so halve the roots that have links. n
    linked texts need at most 2 * log2(n) rounds; a bound that is hit raises. Each round is
    written to the shared folder, and only whether links are left comes to the driver.
    """
    edges = links.select("rep_a", "rep_b")
    both = stored(edges.unionByName(edges.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"))), "links")
    label, left = None, both
    for _ in range(max_rounds):
        hooked = left.groupBy(F.col("rep_a").alias("rep")).agg(F.min("rep_b").alias("least")).select("rep", F.least("rep", "least").alias("root"))
        root = _roots(stored(hooked, "parents"), max_rounds)
        further = root.select(F.col("rep").alias("at"), F.col("root").alias("further"))
        if label is None:
            label = root
        else:
            label = label.join(further, F.col("root") == F.col("at"), "left").select("rep", F.coalesce("further", "root").alias("root"))
            label = stored(label, "labels")
        a, b = (root.select(F.col("rep").alias(f"rep_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
        between = left.join(a, "rep_a").join(b, "rep_b").where("root_a != root_b")
        left = stored(between.select(F.col("root_a").alias("rep_a"), F.col("root_b").alias("rep_b")).distinct(), "links")
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"groups have not settled after {max_rounds} rounds")
    degree = both.groupBy(F.col("rep_a").alias("rep")).agg(F.count("*").alias("links"))
    known = label.join(degree, "rep")
    return membership.join(known, "rep", "left").select("id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
