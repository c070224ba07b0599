"""Queries of problems 3, 7, 8 and 9 over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.leakage import leaked
from marginalia.llm.packing import pack, sizes, tokenizer_path, violations
from marginalia.llm.subjects import fit, subjects_of
from marginalia.llm.truncation import truncated
from marginalia.operators.shared import written
from marginalia.sources.tables import read_table, source_host


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each item that leaked into it and the letters they share."""
    items = read_table(spark, sf_dir, "eval_items").withColumn("stretch", F.when(F.lower("lang").startswith("zh"), 24).otherwise(60))
    return leaked(read_table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text", "stretch")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document with the share of its sentences that are about each."""
    docs = read_table(spark, sf_dir, "documents")
    names = sorted(r[0] for r in read_table(spark, sf_dir, "subjects").select("subject").where("subject IS NOT NULL").distinct().collect())
    h = fit(docs, "doc_id", "text", read_table(spark, sf_dir, "subject_labels"), "subject", names)
    return subjects_of(docs, "doc_id", "text", h, names)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).select("doc_id", "subject")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of the corpus: documents and mean share of each subject."""
    return p9_subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 4).alias("mean_share"))


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = read_table(spark, sf_dir, "knowledge").select("id", "summary_markdown", source_host(F.col("source_url")).alias("host"))
    return truncated(notes, "id", "summary_markdown", "host")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endings(spark, sf_dir).where("cut").select("id")


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source host: its notes, those cut, and their share."""
    n = F.count("*")
    cut = F.count_if("cut")
    return _endings(spark, sf_dir).groupBy(F.col("source").alias("host")).agg(n.alias("notes"), cut.alias("cut"), F.round(cut / n, 6).alias("share"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    kinds = [(r[0], r[1]) for r in read_table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens").collect()]
    return sizes(read_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path()), kinds


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of each kind: container number, document, order and token range."""
    return pack(*_sized(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def p7_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the plain online order, without looking ahead."""
    return pack(*_sized(spark, sf_dir), open_bins=256, window=1).withColumnRenamed("key", "doc_id")


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often ``p7_packed`` breaks a rule of a valid filling."""
    sized, kinds = _sized(spark, sf_dir)
    sized = written(sized)
    return violations(written(pack(sized, kinds)), sized, kinds)


QUERIES: dict = {"p3_found": p3_found, "p3_sources": p3_sources, "p7_packed": p7_packed, "p7_online": p7_online, "p7_violations": p7_violations, "p9_found": p9_found, "p9_subjects": p9_subjects, "p9_mix": p9_mix, "p8_found": p8_found, "p8_leaks": p8_leaks}
_LEAKS = r"""WITH i AS (SELECT item_id, CASE WHEN lower(lang) LIKE 'zh%' THEN 24 ELSE 60 END AS n, lower(regexp_replace(text, '[^\p{L}]', '', 'g')) AS q FROM eval_items),
  d AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}]', '', 'g')) AS q FROM documents WHERE text IS NOT NULL),
  iw AS (SELECT item_id, n, length(q) AS letters, unnest(range(1, length(q) - n + 2)) AS p, q FROM i), iv AS (SELECT item_id, n, letters, p, substr(q, p, n) AS w FROM iw),
  dw AS (SELECT doc_id, n, q, unnest(range(1, length(q) - n + 2)) AS p FROM d, (VALUES (24), (60)) AS v(n)), dv AS (SELECT DISTINCT doc_id, substr(q, p, n) AS w FROM dw),
  h AS (SELECT DISTINCT doc_id, item_id, letters, n, p FROM iv JOIN dv USING (w)), c AS (SELECT doc_id, item_id, letters, unnest(range(p, p + n)) AS spot FROM h),
  s AS (SELECT doc_id, item_id, letters, count(DISTINCT spot) AS n FROM c GROUP BY ALL)
  SELECT doc_id, item_id, n AS shared_letters, letters AS item_letters FROM s WHERE n * 5 >= 2 * letters"""
ORACLE: dict[str, str] = {"p8_leaks": _LEAKS, "p8_found": f"SELECT doc_id, item_id FROM ({_LEAKS})", "p7_violations": "SELECT rule, CAST(broken AS BIGINT) AS broken FROM (VALUES ('overfull', 0), ('free space wrong', 0), ('orders with gaps', 0), ('numbers with gaps', 0), ('text not whole', 0), ('split without need', 0)) AS v(rule, broken)"}
