"""Queries over fields that pack several values (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.packed_values import delimiter_scores, delimiter_stats, explode_packed, split_packed
from marginalia.sources.tables import read_table, source_host


def note_tags(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All notes with ``columns`` and ``tag_list``, the tags of the note in written order."""
    notes = read_table(spark, sf_dir, "knowledge").select(*columns, "tags", source_host(F.col("source_url")).alias("host"))
    return split_packed(notes, "tags", "host", "tag_list").drop("tags", "host")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = read_table(spark, sf_dir, "knowledge").select("id", "tags", source_host(F.col("source_url")).alias("host"))
    return explode_packed(notes, "id", "tags", "host", "tag", min_values=2)


def p4_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delimiters of each source with their support and score."""
    notes = read_table(spark, sf_dir, "knowledge").select("tags", source_host(F.col("source_url")).alias("host"))
    return delimiter_scores(delimiter_stats(notes, "tags", "host")).select(F.col("source").alias("host"), "delimiter", "support", F.round("score", 6).alias("score"))


QUERIES = {"p4_found": p4_found, "p4_dialects": p4_dialects}

# The SQL infers nothing: it takes every candidate for a delimiter, reads a text as quoted runs, delimiters and
# the rest, and numbers the pieces between delimiters.
_SEP = r"(?:[,，、;；|｜\t\r\n]|\s/\s)"
_QUOTED = r"""(?:"(?:[^"]|"")*"|“[^”]*”|''[^'']*''|‘[^’]*’|「[^」]*」|『[^』]*』|«[^»]*»|`[^`]*`)"""
_BLANKS = r"[\s\p{Z}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x00-\x1f]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


def _cleaned(x: str) -> str:
    x = _stripped(f"regexp_replace({_stripped(x)}, '^(?:[-*•·–]\\s+|\\d{{1,3}}[.)]\\s+)', '')")
    x = _stripped(f"regexp_replace({x}, '^#+', '')")
    for o, c in ('""', "“”", ("''", "''"), "‘’", "「」", "『』", "«»", "``"):
        x = f"regexp_replace({x}, '^{o}(.*){c}$', '\\1', 's')"
    x = _stripped(f"regexp_replace({_stripped(x)}, '^#+(.)', '\\1')")
    return f"nullif(replace({x}, '\"\"', '\"'), '#')"


def tags_sql(table: str = "knowledge") -> str:
    """CTEs up to ``tags`` (id, pos, tag): every tag of every note in written order."""
    token = f"(?:^|{_SEP})[ \\t]*(?:[#*•\\-]\\s?)?{_QUOTED}|{_SEP}|[^,，、;；|｜\\s]+|\\s"
    run = r"list_transform(regexp_extract_all(regexp_replace(piece, '#(\s*)(#|$)', chr(2) || '\1\2', 'g'), '#([^#]+)', 1), lambda x: replace(x, chr(2), '#'))"
    return f"""t AS (SELECT id, tags AS s, regexp_full_match(tags, '\\s*\\[.*\\]\\s*', 's') AS listed FROM {table} WHERE tags IS NOT NULL),
      j AS (SELECT id, s, listed AND json_valid(s) AS json, CASE WHEN listed THEN regexp_replace(s, '^\\s*\\[|\\]\\s*$', '', 'g') ELSE s END AS bare FROM t),
      k AS (SELECT id, regexp_extract_all(bare, '{token}') AS k FROM j WHERE NOT json), u AS (SELECT id, unnest(k) AS tok, generate_subscripts(k, 1) AS i FROM k),
      g AS (SELECT id, i, tok, sum(CAST(regexp_matches(tok, '^{_SEP}') AS INT)) OVER (PARTITION BY id ORDER BY i) AS g FROM u),
      p AS (SELECT id, g, regexp_replace(string_agg(tok, '' ORDER BY i), '^{_SEP}', '') AS piece FROM g GROUP BY id, g),
      r AS (SELECT id, g, CASE WHEN regexp_matches(trim(piece), '^#[^#]+#') THEN {run} ELSE [piece] END AS r FROM p),
      x AS (SELECT id, g, generate_subscripts(r, 1) AS h, unnest(r) AS piece FROM r),
      c AS (SELECT id, g, h, {_cleaned('piece')} AS tag FROM x
        UNION ALL SELECT id, generate_subscripts(l, 1) AS g, 1 AS h, {_stripped('unnest(l)')} FROM (SELECT id, from_json(s, '["VARCHAR"]') AS l FROM j WHERE json)),
      tags AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY g, h) AS pos, tag FROM c WHERE tag IS NOT NULL AND tag != '')"""


ORACLE: dict[str, str] = {"p4_found": f"WITH {tags_sql()} SELECT id, pos, tag FROM tags QUALIFY count(*) OVER (PARTITION BY id) >= 2"}
