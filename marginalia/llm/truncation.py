"""Texts cut off by field limits or during transfer.

Structure first. The lines of a text are read by an automaton with a stack: code fences and
formula blocks span lines, quotes, brackets and inline markup belong to one line. What may
have been added after the end is taken off (closing blocks, links, tables, tag lines, closing
lists, and lines that many notes of a source end with, of any number and length), and the last line of the body is
classified: ended by a stop; left open (an unclosed fence, quote, bracket or markup, a broken
multibyte sequence, escape or entity, a heading or list mark with nothing behind it); or ended
by nothing.

The endings without a stop are judged against baselines. Per source: lengths, in characters
and bytes, at which unended texts pile up are its limits, and its rate of unended texts is the
prior. Over all sources: a model of sentence ends, fitted on at most ``SAMPLE_SENTENCES``
sentences and their own prefixes, tells a sentence that lacks its stop from one that breaks
off.

Defined cases: null, empty and blank texts are not cut, nor are texts of which nothing is left
below what was added; a source is the host of the row, null becomes the source "".
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import codes as C
from marginalia.operators.bounded import bounded_side
from marginalia.operators.shared import written

STOPS = "。！？!?.‽｡"
CLOSERS = "”’」』）)】]》〉\"'*_`~ \t"
PAIRS = {"“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "[": "]", "《": "》"}
_OPENER = {close: opening for opening, close in PAIRS.items()}
BROKEN = "�"
#: A line that at least this share of all notes, or of a source's notes, end with was added.
FOOTER_SHARE, FOOTER_SOURCE_SHARE, FOOTER_COUNT = 0.005, 0.05, 4
#: Unended texts at one length, against the mean of the lengths around it, that make a limit.
LIMIT_COUNT, LIMIT_TIMES, LIMIT_REACH, LIMIT_SHARE = 4, 8.0, 25, 0.004
SAMPLE_SENTENCES = 40_000
#: Sources with added lines that are broadcast to the compact table of last lines.
MAX_BROADCAST_SOURCES = 20_000
#: (source, line) keys of eight bytes that are broadcast to the texts: 32 MB.
MAX_BROADCAST_FOOTERS = 4_000_000
#: Parts of a source beyond that bound.
SALTS = 64

ENDED, OPEN, UNENDED, EMPTY = "ended", "open", "unended", "empty"
_BREAK = re.compile(r"\r\n|\r|\n")
_HEADING = re.compile(r"^\s{0,3}#{1,6}(?:\s|$)")
_MARK = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)、])\s*(?:\*\*[^*]*\*\*\s*[:：])?\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)、])\s+")
_ADDED = re.compile(r"^\s*(?:#[^\s#]+(?:\s+#[^\s#]+)*|\[[^\]]*\]\([^)\s]*\)|\|.*\||\$\$.+\$\$|-{3,}|={3,}|\*{3,})\s*$")
_ELLIPSIS = re.compile(r"(?:…+|\.{3,}|。{3,})\s*$")
_ESCAPE = re.compile(r"(?:&#?[0-9A-Za-z]{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?|<[A-Za-z/!][^<>]*)$")
_FORMULA = re.compile(r"[^\s\d]")
_UNLIKE_ITEM = re.compile(r"[。！？!?，,；;：:�…]|\.$|\.\s")
_INLINE = re.compile(r"\*\*|`+|\$\$?|[“”「」『』（）()【】\[\]《》]")


def open_inline(line: str) -> list[str]:
    """What is still open at the end of a line: the automaton's stack.

    A closing bracket or quote closes only the innermost one; closing markup also closes what
    was left open inside it; nothing but its own end closes inline code.
    """
    stack: list[str] = []
    held = Counter()

    def push(t: str) -> None:
        stack.append(t)
        held[t] += 1

    def close(t: str) -> None:
        while True:
            top = stack.pop()
            held[top] -= 1
            if top == t:
                return

    for m in _INLINE.finditer(line):
        t = m.group()
        if stack and stack[-1][0] == "`":
            if t == stack[-1]:
                close(t)
        elif t in PAIRS:
            push(t)
        elif t in _OPENER:
            if stack and stack[-1] == _OPENER[t]:
                close(stack[-1])
        elif held[t]:
            close(t)
        elif t != "$" or _FORMULA.match(line, m.end()):
            push(t)
    return stack


def _closing_list(lines: list[str], end: int) -> int:
    """Lines before ``end`` of a closing list with its heading: two short items or more, without stops; 0 if there is none."""
    n = 0
    while n < end and _ITEM.match(lines[end - 1 - n]):
        item = _ITEM.sub("", lines[end - 1 - n]).strip()
        if not item or len(item) > 40 or len(item.split()) > 4 or _UNLIKE_ITEM.search(item):
            return 0
        n += 1
    if n < 2:
        return 0
    while n < end and not lines[end - 1 - n].strip():
        n += 1
    return n + 1 if n < end and _HEADING.match(lines[end - 1 - n]) else 0


def ending(text: str, footer=None) -> tuple[str, str, str, str]:
    """(state, reason, fragment, body) of a text; ``footer`` tells whether a line is known to be added."""
    breaks = [(m.start(), m.end()) for m in _BREAK.finditer(text)]
    begins, ends = [0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)]
    lines = [text[a:b] for a, b in zip(begins, ends)]
    fences = [i for i, x in enumerate(lines) if x.lstrip().startswith("```")]
    if len(fences) % 2:
        return OPEN, "code fence", "", text.rstrip()
    end, added = len(lines), ""
    while end:
        line = lines[end - 1]
        if not line.strip():
            end -= 1
        elif footer is not None and footer(line):
            end, added = end - 1, "footer"
        elif fences and fences[-1] == end - 1:
            fences.pop()
            end, added = fences.pop(), "block"
        elif _ADDED.match(line):
            end, added = end - 1, "block"
        elif n := _closing_list(lines, end):
            end, added = end - n, "list"
        else:
            break
    if not end:
        return EMPTY, "", "", ""
    last = lines[end - 1].rstrip().rstrip("​﻿").rstrip()
    body = text[: ends[end - 1]].rstrip()  # with its own line ends: limits count them
    bare = _ELLIPSIS.sub("", last).rstrip()
    if bare.endswith(BROKEN):
        return OPEN, "multibyte", last, body
    if _HEADING.match(last):
        return OPEN, "heading", last, body
    if _MARK.match(last):
        return OPEN, "list mark", last, body
    dots = bare != last
    core = bare.rstrip(CLOSERS)
    if core and core[-1] in STOPS:
        return ENDED, "", "", body
    if stack := open_inline(bare):
        return OPEN, f"unclosed {stack[-1]}", last, body
    if _ESCAPE.search(bare) and not re.search(r"\s[&%]\s*$", bare):
        return OPEN, "escape", last, body
    sentence = re.split(r"[。！？!?]|\.(?=\s)", _ITEM.sub("", bare))[-1].strip()
    return UNENDED, "ellipsis" if dots else added and "added", sentence, body


# ---------------------------------------------------------------- sentence ends

SLOTS = 1 << 16


def _features(s: str) -> list[int]:
    """Hashed features of how a sentence begins, how its last clause begins and how it ends."""
    import zlib

    s = re.sub(r"\d+", "0", s.lower())
    clauses = [c.strip() for c in re.split(r"[，,；;：:]", s)]
    last, first = clauses[-1], clauses[0]
    spaced = " " in s
    f = [f"e{n}:{s[-n:]}" for n in range(1, 9) if n <= len(s)]
    f += [f"l{min(len(last) // (6 if spaced else 2), 14)}", f"c{min(len(clauses), 5)}"]
    if spaced:
        w, lw = s.split(), last.split()
        f += [f"w1:{w[-1]}", f"w2:{' '.join(w[-2:])}", f"w3:{' '.join(w[-3:])}"]
        heads = [" ".join(first.split()[:2]), " ".join(lw[:2]), " ".join(lw[:1])]
        f += [f"h{i}:{h}|{min(len(lw), 14)}" for i, h in enumerate(heads)]
        f += [f"v{i}:{h}|{w[-1]}" for i, h in enumerate(heads)]
        f += [f"b{i}:{' '.join(lw[i : i + 2])}|{len(lw) - i - 2}" for i in range(max(0, len(lw) - 7), len(lw) - 1)]
    else:
        heads = [first[:2], last[:2], last[:4]]
        f += [f"h{i}:{h}|{min(len(last), 25) // 2}" for i, h in enumerate(heads)]
        f += [f"v{i}:{h}|{s[-2:]}" for i, h in enumerate(heads)]
        f += [f"b:{last[i : i + 2]}|{len(last) - i - 2}" for i in range(max(0, len(last) - 10), len(last) - 1)]
    f += [f"k{len(clauses) > 1}:{s[-3:]}"]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in f]


def fit_sentence_ends(sentences: list[str], rounds: int = 4) -> np.ndarray:
    """Weights of a logistic model: 1 for whole sentences without their stop, 0 for their prefixes."""
    rng = np.random.default_rng(11)
    rows, y = [], []
    for s in sentences:
        if len(s) < 6:
            continue
        rows += [_features(s), _features(s[: int(rng.integers(3, len(s)))].strip() or s[:3])]
        y += [1.0, 0.0]
    weights, square = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-6)
    if not rows:
        return weights
    width = np.array([len(r) for r in rows])
    flat, start = np.concatenate([np.array(r, np.int64) for r in rows]), np.r_[0, np.cumsum(width)]
    y = np.array(y)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            ids = np.concatenate([flat[start[i] : start[i + 1]] for i in pick])
            owner = np.repeat(np.arange(len(pick)), width[pick])
            z = np.bincount(owner, weights[ids], len(pick)) + weights[SLOTS]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            grad = g[owner] + 1e-4 * weights[ids]
            np.add.at(square, ids, grad * grad)
            np.add.at(weights, ids, -0.15 * grad / np.sqrt(square[ids]))
            square[SLOTS] += (g * g).sum()
            weights[SLOTS] -= 0.15 * g.sum() / np.sqrt(square[SLOTS])
    return weights


def score(weights: np.ndarray, s: str) -> float:
    """Log odds that ``s`` is a whole sentence without its stop."""
    return float(weights[_features(s)].sum() + weights[SLOTS])


def whole_sentences(text: str) -> list[str]:
    """The sentences of 6 to 400 characters that end with a stop, without it."""
    out = []
    for line in re.split(r"[\r\n]+", text):
        if not _HEADING.match(line) and not line.startswith(("|", "`", "$", ">", "[")):
            parts = re.split(r"[。！？!?]|\.(?=\s|$)", _ITEM.sub("", line))
            out += [p.strip() for p in parts[:-1] if 6 <= len(p.strip()) <= 400]
    return out


# ---------------------------------------------------------------- the operator


class Footers:
    """Keys of added lines: of all sources, and sorted keys of (source, line); ``in`` asks for one source's line."""

    def __init__(self, everywhere: frozenset[int], pairs: np.ndarray):
        self.everywhere, self.pairs = everywhere, pairs

    def of(self, source: str, own: list[int] | None):
        """Whether a line of a text of ``source`` was added; ``own``: the source's lines where they came with the text."""
        more = frozenset(own or ())

        def added(line: str) -> bool:
            k = _line_key(line)
            if k in self.everywhere or k in more:
                return True
            if not len(self.pairs):
                return False
            p = _pair_key(source, k)
            at = np.searchsorted(self.pairs, p)
            return bool(at < len(self.pairs) and self.pairs[at] == p)

        return added


def _endings(batches: Iterator[pa.RecordBatch], footers: Footers) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, source, t, own in (r for s in C.slices(batch) for r in zip(*s)):
            state, why, fragment, body = ending(t, footers.of(source, own))
            size = len(body.encode("utf-8", "surrogatepass"))
            broken = bool(re.search(BROKEN + r"[.…]*$", body))
            rows.append((i, source, state, why, fragment, len(body), size - 3 * broken))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["id", "source", "state", "why", "fragment", "chars", "bytes"])


def _line_key(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - (1 << 63)


def _pair_key(source: str, line: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass") + line.to_bytes(8, "little", signed=True)) - (1 << 63)


def tail_lines(text: str) -> list[int]:
    """Keys of the lines of a text from its end up to the first list item, heading or fence, without the blocks that count as added anyway and without its first line."""
    lines = [x for x in _BREAK.split(text) if x.strip()]
    out = []
    for line in lines[:0:-1]:
        if _ADDED.match(line):
            continue
        if _ITEM.match(line) or _HEADING.match(line) or line.lstrip().startswith("```"):
            break
        out.append(_line_key(line))
    return out


_TAILS = "source string, tail array<long>, sentences array<string>"


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text the keys of its last lines, and of the sampled ones the sentences."""
    for batch in batches:
        sources, tails, sentences = [], [], []
        for source, t, sampled in (r for s in C.slices(batch) for r in zip(*s)):
            sources.append(source)
            tails.append(tail_lines(t))
            sentences.append(whole_sentences(t) if sampled else None)
        yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(tails, pa.list_(pa.int64())), pa.array(sentences, pa.list_(pa.string()))], names=["source", "tail", "sentences"])


def footer_lines(tails: DataFrame) -> tuple[frozenset[int], DataFrame]:
    """Keys of the lines that too many notes end with for them to be the notes' own.

    Those of all rows, and (source, lines) of single sources. A footer may have any number of
    lines: what is found is taken off, and the lines before it are counted in the next round,
    until a round finds none. A round knows at most 1 / ``FOOTER_SHARE`` lines of all rows and
    1 / ``FOOTER_SOURCE_SHARE`` of a source.
    """
    spark = tails.sparkSession
    sizes = written(tails.groupBy("source").agg(F.count("*").alias("of")))
    total = sizes.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    everywhere: frozenset[int] = frozenset()
    by_source = spark.createDataFrame([], "source string, lines array<long>")
    while True:
        side, _ = bounded_side(by_source, MAX_BROADCAST_SOURCES)
        known = F.array_union(F.coalesce("lines", F.array().cast("array<long>")), F.lit(sorted(everywhere)).cast("array<long>"))
        rest = F.array_except("tail", known)  # keeps the order; a footer's lines are taken off wherever they stand
        last = tails.where(F.size("tail") > 0).join(side, "source", "left").select("source", F.get(rest, 0).alias("line")).where("line IS NOT NULL")
        counts = written(last.groupBy("source", "line").agg(F.count("*").alias("n")))
        often = counts.where(F.col("n") >= FOOTER_COUNT).join(sizes, "source").where(F.col("n") >= FOOTER_SOURCE_SHARE * F.col("of")).select("source", "line")
        overall = counts.groupBy("line").agg(F.sum("n").alias("n")).where((F.col("n") >= FOOTER_COUNT) & (F.col("n") >= FOOTER_SHARE * total))
        new = frozenset(r["line"] for r in overall.collect())
        more = often.where(~F.col("line").isin(*new)) if new else often
        grown = by_source.select("source", F.explode("lines").alias("line")).unionByName(more)
        grown = written(grown.groupBy("source").agg(F.sort_array(F.collect_set("line")).alias("lines")))
        found = bool(new) or more.limit(1).count() > 0
        everywhere, by_source = everywhere | new, grown
        if not found:
            return everywhere, by_source


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_pair_key(s, k) for s, lines in zip(*C.columns(batch)) for k in lines]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["k"])


def limits(ends: DataFrame) -> DataFrame:
    """(source, metric, size): lengths at which a source's unended texts pile up."""
    loose = ends.where(F.col("state").isin(UNENDED, OPEN))
    sized = loose.select("source", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("metric", "size"))
    n = sized.groupBy("source", "metric", "size").agg(F.count("*").alias("n"))
    around = Window.partitionBy("source", "metric").orderBy("size").rangeBetween(-LIMIT_REACH, LIMIT_REACH)
    total = ends.groupBy("source").agg(F.count("*").alias("of"))
    mean = (F.sum("n").over(around) - F.col("n")) / (2.0 * LIMIT_REACH)
    n = n.withColumn("mean", mean).join(total, "source")
    return n.where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_TIMES * F.greatest("mean", F.lit(0.25))) & (F.col("n") >= LIMIT_SHARE * F.col("of"))).select("source", "metric", "size")


def _scores(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = batch.column("fragment").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(weights, x) if x else 0.0 for x in s], pa.float64())], names=[*batch.schema.names, "whole"])


def truncated(df: DataFrame, key: str, text: str, source: str, sample: int = SAMPLE_SENTENCES) -> DataFrame:
    """(id, source, cut, why) of every row with a text."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("t")).where("t IS NOT NULL")
    # about ten sentences a text: a sample of texts by the hash of the id, then a bound on the sentences
    part = min(1.0, sample / 4 / max(1, df.count()))
    sampled = F.coalesce(F.abs(F.xxhash64("id") % 1_000_000) < int(part * 1_000_000) + 1, F.lit(False))
    tails = written(rows.select("source", "t", sampled.alias("sampled")).mapInArrow(_tails, _TAILS))
    everywhere, by_source = footer_lines(tails.select("source", "tail"))
    pairs = by_source.mapInArrow(_pair_keys, "k long").limit(MAX_BROADCAST_FOOTERS + 1).toArrow()["k"].to_numpy()
    lined = rows.withColumn("lines", F.lit(None).cast("array<long>"))
    if len(pairs) > MAX_BROADCAST_FOOTERS:  # then each text gets its source's lines, over salted sources
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        lined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(by_source.withColumn("salt", salts), ["source", "salt"], "left").select("id", "source", "t", "lines")
        pairs = pairs[:0]
    footers = spark.sparkContext.broadcast(Footers(everywhere, np.sort(pairs)))
    ends = written(lined.mapInArrow(lambda b: _endings(b, footers.value), "id long, source string, state string, why string, fragment string, chars long, bytes long"))
    some = tails.where("sentences IS NOT NULL").select(F.explode("sentences").alias("s"))
    got = [r[0] for r in some.distinct().orderBy(F.xxhash64("s")).limit(sample).collect()]
    weights = spark.sparkContext.broadcast(fit_sentence_ends(got))
    at = limits(ends)
    at_c = at.where("metric = 'chars'").select(F.col("source").alias("cs"), F.col("size").alias("cz")).withColumn("at_c", F.lit(True))
    at_b = at.where("metric = 'bytes'").select(F.col("source").alias("bs"), F.col("size").alias("bz")).withColumn("at_b", F.lit(True))
    loose = ends.where(F.col("state") == UNENDED)
    scored = loose.mapInArrow(lambda b: _scores(b, weights.value), ends.schema.add("whole", "double"))
    scored = scored.join(at_c, (F.col("source") == F.col("cs")) & (F.col("chars") == F.col("cz")), "left")
    scored = written(scored.join(at_b, (F.col("source") == F.col("bs")) & (F.col("bytes") == F.col("bz")), "left"))
    # prior: how often a source's unended texts break off, from the clear cases, shrunk towards even odds
    clear = scored.where("at_c IS NULL AND at_b IS NULL AND abs(whole) > 2")
    prior = clear.groupBy("source").agg(F.sum(F.when(F.col("whole") < 0, 1.0).otherwise(0.0)).alias("c"), F.count("*").alias("k"))
    prior = prior.select(F.col("source").alias("ps"), F.ln((F.col("c") + 2) / (F.col("k") - F.col("c") + 2)).alias("odds"))
    judged = scored.join(prior, F.col("source") == F.col("ps"), "left")
    dots = F.when(F.col("why") == "ellipsis", 3.0).otherwise(0.0)
    broken_off = F.col("at_c").isNotNull() | F.col("at_b").isNotNull() | (F.coalesce("odds", F.lit(0.0)) + dots - F.col("whole") > 0)
    unended = judged.select("id", "source", broken_off.alias("cut"), F.when(F.col("at_c").isNotNull() | F.col("at_b").isNotNull(), "limit").otherwise("sentence").alias("why"))
    rest = ends.where(F.col("state") != UNENDED).select("id", "source", (F.col("state") == OPEN).alias("cut"), "why")
    return rest.unionByName(unended)
