"""Full-text search over title, author, summary and tags: tokens, postings, BM25.

Tokens are runs of letters, digits and private-use characters in lower case; accents of
Latin letters are folded. A run of Chinese characters is one token. A keyword of several
tokens is a phrase. Everything is a column expression over one scan; the statistics are one
global aggregate and join as a single row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import let
from marginalia.operators.shared import written

COLUMNS = ["title", "author", "summary_markdown", "tags"]
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
_BAREWORD = re.compile(r"[A-Za-z0-9_\x80-\U0010FFFF]+\Z")


@functools.cache
def accent_table() -> tuple[str, str]:
    """Latin letters with exactly one accent, and their bases (from the Unicode decompositions)."""
    pairs = []
    for c in [*range(0xC0, 0x370), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) == 2 and unicodedata.combining(d[1]) and chr(c) == chr(c).lower():
            pairs.append((chr(c), d[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


# Ranges of the combining marks that vanish inside a token; all others separate tokens.
MARK_RANGES = ((0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311), (0x31B, 0x31B), (0x323, 0x328), (0x32D, 0x32E), (0x330, 0x331))
MARKS = "".join(chr(c) for a, b in MARK_RANGES for c in range(a, b + 1))


def fold_accents(c: Column) -> Column:
    low = F.lower(c)
    src, dst = accent_table()
    # what has no counterpart is dropped
    return F.when(low.rlike("[\u00c0-\u036f\u1e00-\u1eff]"), F.translate(low, src + MARKS, dst)).otherwise(low)


def tokens(c: Column) -> Column:
    """Tokens of a text in order; null gives an empty array."""
    return F.regexp_extract_all(fold_accents(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def py_tokens(s: str) -> list[str]:
    src, dst = accent_table()
    s = s.lower().translate(str.maketrans(src, dst, MARKS))
    return re.findall(r"[^\W_]+", s)


def postings(notes: DataFrame) -> DataFrame:
    """(id, col, token, pos): the inverted index, a function of the notes alone."""
    per = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("tokens")) for c in COLUMNS])
    one = notes.select("id", F.explode(per).alias("c"))
    return one.select("id", "c.col", F.posexplode("c.tokens").alias("pos", "token"))


def document_frequency(notes: DataFrame) -> DataFrame:
    """(token, notes, occurrences); repeats within a note are counted before the shuffle."""
    arrays = notes.select(F.concat(*[tokens(F.col(c)) for c in COLUMNS]).alias("t"))
    new = lambda a, t, i: F.when(i == 0, 1).when(F.get(a, i - 1) != t, 1).otherwise(0)
    flagged = let(F.sort_array("t"), lambda a: F.transform(a, lambda t, i: F.struct(t.alias("token"), new(a, t, i).alias("first"))))
    return arrays.select(F.explode(flagged).alias("e")).groupBy(F.col("e.token").alias("token")).agg(
        F.sum("e.first").cast("long").alias("notes"), F.count("*").alias("occurrences")
    )


def parse_match(keywords: list[str]) -> list[list[str]] | None:
    """The phrases of keywords joined by OR; None if the grammar rejects the query."""
    phrases = []
    for k in keywords:
        if not _BAREWORD.match(k) or k in ("AND", "OR", "NOT"):
            return None
        words = py_tokens(k)
        if words:
            phrases.append(words)
    return phrases


def token_line(notes_columns: list[str]) -> Column:
    """The tokens of all columns in one string: a blank before and behind each, a control character between columns."""
    normal = [F.concat(F.lit(" "), F.regexp_replace(fold_accents(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+", " "), F.lit(" ")) for c in notes_columns]
    return F.concat_ws("\x01", *normal)


def phrase_count(line: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in a token line; overlapping ones count each."""
    return F.regexp_count(line, F.lit(rf"(?= \Q{' '.join(phrase)}\E )"))


def counted(notes: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, d, f0, f1, ...): tokens of every note and occurrences of every phrase, from one scan, written once."""
    lines = notes.select("id", token_line(COLUMNS).alias("line"))
    length = F.regexp_count(F.col("line"), F.lit(r"[^ \x01]+")).cast("double").alias("d")
    counts = [phrase_count(F.col("line"), p).cast("double").alias(f"f{i}") for i, p in enumerate(phrases)]
    return written(lines.select("id", length, *counts))


def bm25_many(notes: DataFrame, queries: dict[int, list[list[str]]], limit: int | None = None) -> DataFrame:
    """(query_no, id, rank) of the notes with at least one phrase of a query; rank is negative, the best first.

    With a ``limit`` the best notes of each query, ties by id.
    """
    order: dict[tuple[str, ...], int] = {}
    for phrases in queries.values():
        for p in phrases:
            order.setdefault(tuple(p), len(order))
    rows = counted(notes, [list(p) for p in order])
    per_phrase = [F.sum(F.when(F.col(f"f{i}") > 0, 1.0).otherwise(0.0)).alias(f"n{i}") for i in order.values()]
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.sum("d").alias("total"), *per_phrase)
    return ranked(rows, stats, queries, order, limit)


def ranked(rows: DataFrame, stats: DataFrame, queries: dict[int, list[list[str]]], order: dict[tuple[str, ...], int], limit: int | None) -> DataFrame:
    """(query_no, id, rank) from (id, d, f0, f1, ...) and one row (n, total, n0, n1, ...); ``order`` numbers the phrases."""

    def term(i: int) -> Column:
        df, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        return idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("d") / (F.col("total") / F.col("n"))))

    entries = []
    for q, phrases in queries.items():
        at = [order[tuple(p)] for p in phrases]
        hit = functools.reduce(lambda x, y: x | y, [F.col(f"f{i}") > 0 for i in at], F.lit(False))
        rank = functools.reduce(lambda x, y: x - term(y), at, F.lit(0.0))
        entries.append(F.when(hit, F.struct(F.lit(q).alias("query_no"), F.round(rank, 9).alias("rank"))))
    scored = rows.crossJoin(F.broadcast(stats))  # stats: one row
    scored = scored.select("id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.query_no", "id", "e.rank")
    if limit is None:
        return scored
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy("query_no").orderBy("rank", "id"))).where(F.col("rk") <= limit)


def bm25(notes: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, rank) for one query."""
    return bm25_many(notes, {0: phrases}).select("id", "rank")


def spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The tokens of a text and where they stand in it."""
    import regex

    src, dst = accent_table()
    fold = str.maketrans(src, dst, MARKS)
    at = [m.span() for m in regex.finditer(rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{MARKS}]*", text)]
    return [text[a:b].lower().translate(fold) for a, b in at], at


def snippet_text(text: str, phrases: list[list[str]], size: int = 40) -> str:
    """The ``size`` tokens of a text that show its phrases best, which are put in **.

    A window is worth 1,000 for each phrase in it and 1 for each further occurrence, and 100 more (120 at
    the beginning of the text) if it begins a sentence. Windows are tried around every
    occurrence and at the beginning of its sentence; of equal ones the first wins.
    """
    tokens, at = spans(text)
    n = len(tokens)
    hits = sorted((i, k) for k, p in enumerate(phrases) for i in range(n - len(p) + 1) if tokens[i : i + len(p)] == p)
    opens = [i for i, (a, _) in enumerate(at) if i == 0 or (gap := text[:a].rstrip(" \t\n\r")) != text[:a] and gap.endswith((".", ":"))] if n > size and hits else []

    def worth(start: int) -> tuple[int, int]:
        """(score, start of the window with its occurrences in the middle)."""
        inside = [(i, k) for i, k in hits if start <= i < start + size]
        first, last = inside[0][0], inside[-1][0] + len(phrases[inside[-1][1]])
        kinds = len({k for _, k in inside})
        return 999 * kinds + len(inside), max(0, min(first - int((size - (last - first)) / 2), n - size))

    best, start = 0, 0
    for i, _ in hits:
        score, middle = worth(i)
        if score > best:
            best, start = score, middle
        before = max((o for o in opens if o <= i), default=i)
        if before < i:
            score = worth(before)[0] + (100 if before else 120)
            if score > best:
                best, start = score, before
    end = min(start + size, n) - 1
    out, place = ["..." if start else ""], at[start][0] if start else 0
    shown: list[list[int]] = []  # overlapping occurrences are one
    for i, k in hits:
        if shown and i <= shown[-1][1]:
            shown[-1][1] = max(shown[-1][1], i + len(phrases[k]) - 1)
        else:
            shown.append([i, i + len(phrases[k]) - 1])
    for a, b in shown:
        if start <= a <= end:
            out += [text[place : at[a][0]], "**", text[at[a][0] : at[min(b, end)][1]], "**"]
            place = at[min(b, end)][1]
    out.append(text[place:] if end >= n - 1 else text[place : at[end][1]] + "...")
    return "".join(out)


def with_snippets(rows: DataFrame, text: str, phrases: list[list[str]], when: str, otherwise: str, size: int = 40) -> DataFrame:
    """``rows`` with the column ``snippet`` in place of ``text``: where ``when`` holds from the whole text, else the column ``otherwise``."""
    kept = [f for f in rows.schema if f.name not in (text, when, otherwise)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", snippet string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = zip(*(b.column(c).to_pylist() for c in (when, text, otherwise)))
            found = [snippet_text(t or "", phrases, size) if w else o for w, t, o in shown]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(found, pa.string())], names=[*(f.name for f in kept), "snippet"])

    return rows.mapInArrow(run, schema)
