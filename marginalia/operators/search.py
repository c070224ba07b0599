"""Ranked search by three strategies, and the strict search for all keywords.

Candidates carry (strategy, keyword, rank within both); a rank counts at most ``limit``
deep, an id keeps its first candidate, and the first ``limit`` ids are the result. The
strategies: tags by keyword, BM25 over all keywords, substrings of title, summary and tags
by keyword. Substring strategies of all queries share one scan; their per-keyword limits are
applied inside each partition before the shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import fts
from marginalia.operators.like import has, split_keywords
from marginalia.operators.postings import PostingsIndex
from marginalia.operators.store import newest

RESULT = ["id", "video_id", "title", "author", "tags", "source_url", "created_at", "duration_seconds", "video_code", "timestamp"]
MAX_QUERIES = 1000


def _any_column(keyword: str, columns: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.coalesce(has(F.col(c), keyword), F.lit(False)) for c in columns])


def search_many(notes: DataFrame, queries: list[str], limit: int = 10, index: PostingsIndex | None = None) -> DataFrame:
    """(query_no, place, id, strategy) of each query; ``queries``: at most ``MAX_QUERIES``.

    With an ``index`` of the notes the full-text strategy reads postings instead of texts.
    """
    if limit < 0 or len(queries) > MAX_QUERIES:
        raise ValueError("the limit must not be negative, nor the queries too many")
    found, scored = [], {}
    for q, query in enumerate(queries):
        words = split_keywords(query)
        for k, word in enumerate(words or [query.strip()]):
            for strategy, columns in ((1, ["tags"]), (3, ["title", "summary_markdown", "tags"])):
                found.append(F.when(_any_column(word, columns), F.struct(F.lit(q).alias("query_no"), F.lit(strategy).alias("strategy"), F.lit(k).alias("kw"))))
        phrases = fts.parse_match(words)
        if phrases:
            scored[q] = phrases
    hits = notes.select("id", "created_at", F.explode(F.array_compact(F.array(*found))).alias("e")).select("id", "created_at", "e.*")
    by_date = Window.partitionBy("query_no", "strategy", "kw").orderBy(*newest())
    ranked = hits.withColumn("rk", F.row_number().over(by_date)).where(F.col("rk") <= limit).select("query_no", "strategy", "kw", "rk", "id")
    if scored:
        top = index.bm25_many(scored, limit) if index else fts.bm25_many(notes, scored, limit)
        ranked = ranked.unionByName(top.select("query_no", F.lit(2).alias("strategy"), F.lit(0).alias("kw"), "rk", "id"))
    first = ranked.groupBy("query_no", "id").agg(F.min(F.struct("strategy", "kw", "rk")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_no").orderBy("at"))  # at most 2 x keywords + 1 times ``limit`` rows
    return first.withColumn("place", place).where(F.col("place") <= limit).select("query_no", F.col("place").cast("long").alias("place"), "id", F.col("at.strategy").alias("strategy"))


def search(notes: DataFrame, query: str, limit: int = 10, index: PostingsIndex | None = None) -> DataFrame:
    """Result columns and snippet in order of ``place``."""
    hits = search_many(notes, [query], limit, index).select("place", "id", "strategy")  # at most ``limit`` rows
    phrases = fts.parse_match(split_keywords(query)) or []
    short = F.substring(F.coalesce("summary_markdown", F.lit("")), 1, 200).alias("short")
    found = notes.join(F.broadcast(hits), "id").select("place", "strategy", *RESULT, "summary_markdown", (F.col("strategy") == 2).alias("full"), short)
    return fts.with_snippets(found, "summary_markdown", phrases, "full", "short").orderBy("place")


def search_precise(notes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The newest notes in which every keyword occurs in tags, title or summary; none for no keyword."""
    if limit < 0:
        raise ValueError("the limit must not be negative")
    words = split_keywords(query)
    every = functools.reduce(lambda a, b: a & b, [_any_column(w, ["tags", "title", "summary_markdown"]) for w in words], F.lit(bool(words)))
    short = F.substring(F.coalesce("summary_markdown", F.lit("")), 1, 200).alias("snippet")
    return notes.where(every).select(*RESULT, short).orderBy(*newest()).limit(limit)
