"""Several values packed in one field: infer the delimiters of each source, split, explode.

Every source gets a dialect. A candidate delimiter is scored on the values of the source
that hold it outside quotes and outside JSON arrays:

* piece-count consistency, 1 / (1 + variation coefficient of the piece counts);
* piece regularity, the share of pieces that look like one value (short, holding a
  letter or digit, without stray brackets or sentence ends).

The product is shrunk towards the score over all sources, so a source with few values
still gets a sensible dialect. Delimiters at or above ``min_score`` are active; the
source's regular expression is built from them and the split runs inside the JVM.

Defined cases: null and empty values give an empty array; a null source is the source "";
values without an active delimiter give one piece; empty pieces vanish and take no
position; repeats stay; malformed JSON is split like any other value after its brackets
are dropped. Columns of the input keep their names; the output column replaces one of the
same name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import BLANK
from marginalia.operators.bounded import bounded_side

#: Candidate delimiters: name -> (regular expression, part of a character class or None).
CANDIDATES: dict[str, tuple[str, str | None]] = {
    "comma": (",", ","),
    "wide_comma": ("，", "，"),
    "enumeration_comma": ("、", "、"),
    "semicolon": (";", ";"),
    "wide_semicolon": ("；", "；"),
    "bar": (r"\|", "|"),
    "wide_bar": ("｜", "｜"),
    "tab": (r"\t", r"\t"),
    "line": (r"[\r\n]", r"\r\n"),
    "spaced_slash": (r"\s/\s", None),
}
#: A doubled quote inside a quoted value, kept as one character while splitting.
INNER_QUOTE = ""
QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "「": "」", "『": "』", "«": "»", "`": "`"}
PRIOR_WEIGHT = 20.0
MAX_BROADCAST_SOURCES = 20_000
_MASK = "|".join(f"(?<![\\p{{L}}\\p{{N}}]){o}[^{c}]*+{c}" for o, c in QUOTES.items())
_REGULAR = r"(?U)^[\s#*•\-Q]*[^\s#*•\-\[\]{}<>。！？!?]?[^\[\]{}<>。！？!?]{0,60}$"


def _is_json(c: Column) -> Column:
    return c.rlike(r"(?s)^\s*\[.*\]\s*$")


def delimiter_stats(df: DataFrame, value: str, source: str) -> DataFrame:
    """(source, delimiter, support, k1, k2, r1): sums over the values that hold a candidate.

    Sums of rows that come and go can be added and taken off (``merged_stats``).
    """
    masked = F.regexp_replace(F.col(value), _MASK, "Q")
    base = df.select(F.coalesce(F.col(source), F.lit("")).alias("source"), masked.alias("m")).where(
        F.col("m").isNotNull() & ~_is_json(F.col("m"))
    )
    found = []
    for name, (rx, _) in CANDIDATES.items():
        pieces = F.filter(F.split(F.col("m"), rx), lambda p: F.trim(p) != "")
        entry = F.struct(
            F.lit(name).alias("delimiter"),
            F.size(pieces).cast("double").alias("k"),
            F.size(F.filter(pieces, lambda p: p.rlike(_REGULAR) & p.rlike(r"[\p{L}\p{N}]|^\s*Q"))).cast("double").alias("r"),
        )
        found.append(F.when(F.col("m").rlike(rx), entry))
    return (
        base.select("source", F.explode(F.array_compact(F.array(*found))).alias("e"))
        .select("source", "e.*")
        .where("k >= 2")
        .groupBy("source", "delimiter")
        .agg(F.count("*").alias("support"), F.sum("k").alias("k1"), F.sum(F.col("k") * F.col("k")).alias("k2"), F.sum("r").alias("r1"))
    )


def merged_stats(*signed: tuple[DataFrame, int]) -> DataFrame:
    """Statistics added up with a sign each."""
    columns = ["support", "k1", "k2", "r1"]
    parts = [s.select("source", "delimiter", *[(F.col(c) * F.lit(sign)).alias(c) for c in columns]) for s, sign in signed]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("source", "delimiter").agg(*[F.sum(c).alias(c) for c in columns]).where("support > 0")


def delimiter_scores(seen: DataFrame) -> DataFrame:
    """(source, delimiter, support, score) of the statistics of every candidate seen in a source."""

    def score(n: Column, k1: Column, k2: Column, r1: Column) -> Column:
        mean = k1 / n
        cv = F.sqrt(F.greatest(k2 / n - mean * mean, F.lit(0.0))) / mean
        return (r1 / k1) / (1 + cv)

    own = seen.withColumn("own", score(F.col("support"), F.col("k1"), F.col("k2"), F.col("r1")))
    prior = own.groupBy("delimiter").agg(
        score(F.sum("support"), F.sum("k1"), F.sum("k2"), F.sum("r1")).alias("prior")
    )  # ten rows at most
    n = F.col("support")
    return own.join(F.broadcast(prior), "delimiter").select(
        "source", "delimiter", "support", ((n * F.col("own") + PRIOR_WEIGHT * F.col("prior")) / (n + PRIOR_WEIGHT)).alias("score")
    )


def _pattern(active: Column) -> Column:
    """The piece regular expression for an array of active delimiter names."""
    inside = F.concat_ws("", *[F.when(F.array_contains(active, n), F.lit(c)) for n, (_, c) in CANDIDATES.items() if c])
    klass = F.concat(F.lit("["), F.when(inside == "", F.lit("\x1f")).otherwise(inside), F.lit("]"))
    slash = F.when(F.array_contains(active, "spaced_slash"), F.lit(r"|\s/\s")).otherwise(F.lit(""))
    sep = F.concat(F.lit("(?:"), klass, slash, F.lit(")"))
    end = F.concat(F.lit(r"(?=\s*(?:"), sep, F.lit("|$))"))
    quoted = [F.concat(F.lit(f"{o}[^{c}]*+{c}"), end, F.lit("|")) for o, c in QUOTES.items()]
    # a delimiter at the very beginning opens its piece; an empty match there would make the search skip it
    return F.concat(F.lit("(?U)(?:^(?!"), sep, F.lit(")|"), sep, F.lit(r")[ \t]*+((?:[#\-*•]\s?)?(?:"), *quoted, F.lit("(?:(?!"), sep, F.lit(r")[\s\S])*+))"))


def dialects(seen: DataFrame, min_score: float = 0.3) -> DataFrame:
    """(source, delimiters, pattern) of the statistics: one row for each source that packs values at all."""
    return (
        delimiter_scores(seen)
        .where(F.col("score") >= min_score)
        .groupBy("source")
        .agg(F.sort_array(F.collect_set("delimiter")).alias("delimiters"))  # ten at most
        .select("source", "delimiters", _pattern(F.col("delimiters")).alias("pattern"))
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{BLANK}]++|[{BLANK}]++$", "")


def clean_piece(p: Column) -> Column:
    """A piece without blanks, list marks, number signs and quotes around it."""
    p = F.regexp_replace(_strip(p), r"(?U)^(?:[-*•·–]\s++|\d{1,3}[.)]\s++)", "")
    p = _strip(F.regexp_replace(p, r"^#++", ""))
    for o, c in QUOTES.items():
        p = F.regexp_replace(p, f"(?s)^{o}(.*){c}$", "$1")
    p = _strip(F.regexp_replace(_strip(p), r"^#++(?=.)", ""))
    return F.when(p == "#", F.lit("")).otherwise(F.regexp_replace(p, INNER_QUOTE, '"'))


def split_values(value: Column, pattern: Column) -> Column:
    """The array of values packed in ``value`` by the piece expression ``pattern``."""
    text = F.regexp_replace(value, r'(?<=[^,，、;；|｜\s])""|""(?=[\p{L}\p{N}])', INNER_QUOTE)
    # one hash run holds several tags; a number sign before the next tag or the end belongs to its tag
    runs = lambda p: F.when(
        F.trim(p).rlike(r"^#[^#]++#"), F.regexp_extract_all(p, F.lit(r"#([^#]++(?:#(?=\s*(?:#|$)))?)"), F.lit(1))
    ).otherwise(F.array(p))
    bare = F.when(_is_json(text), F.regexp_replace(text, r"^\s*\[|\]\s*$", "")).otherwise(text)
    pieces = F.flatten(F.transform(F.regexp_extract_all(bare, pattern, F.lit(1)), runs))
    array = F.when(_is_json(value), F.from_json(value, "array<string>"))
    parsed = F.when(array.isNotNull(), F.transform(array, lambda x: _strip(F.coalesce(x, F.lit(""))))).otherwise(F.transform(pieces, clean_piece))
    return F.coalesce(F.filter(parsed, lambda x: x != ""), F.array().cast("array<string>"))


def split_packed(df: DataFrame, value: str, source: str, out: str = "values", known: DataFrame | None = None) -> DataFrame:
    """``df`` with the array column ``out``: the values packed in ``value``, in written order.

    ``known``: the dialects to split by; without them those of the rows themselves.
    """
    if known is None:
        known, _ = bounded_side(dialects(delimiter_stats(df, value, source)), MAX_BROADCAST_SOURCES)
    known = known.select(F.col("source").alias("__source"), F.col("pattern").alias("__pattern"))
    none = _pattern(F.array().cast("array<string>"))
    return (
        df.withColumn("__source", F.coalesce(F.col(source), F.lit("")))
        .join(known, "__source", "left")
        .withColumn(out, split_values(F.col(value), F.coalesce(F.col("__pattern"), none)))
        .drop("__source", "__pattern")
    )


def explode_packed(df: DataFrame, key: str, value: str, source: str, out: str = "value", min_values: int = 1) -> DataFrame:
    """(key, pos, out): one row per packed value with its position from 1."""
    split = split_packed(df.select(key, value, source), value, source, "__values")
    return (
        split.where(F.size("__values") >= min_values)
        .select(F.col(key), F.posexplode("__values").alias("__pos", out))
        .select(F.col(key), (F.col("__pos") + 1).cast("long").alias("pos"), F.col(out))
    )
