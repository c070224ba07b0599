"""Frequency of every distinct term, kept up to date by signed deltas.

A change is a record's term array with a sign: +1 for an added record, -1 for a deleted
one, and both (old and new terms) for a changed one. A batch of changes is aggregated to
(term, occurrences, records) and merged into persistent counts that are partitioned by
the hash of the term. Only the partitions that a batch touches are read and written
again; a manifest names the current version of each. Every version is written to a new
folder and then a new manifest is put in place by a rename, so a job that dies half-way leaves the
old state valid, and of two writers that started from one state the slower one fails. Batches are
numbered, and one that was applied is not applied again.

Defined cases: null arrays and null or empty terms count nothing; a term repeated in a
record counts each time as an occurrence and once as a record; terms whose counts return
to zero leave the state; an empty batch changes nothing but is remembered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import let
from marginalia.operators.shared import Manifests, delete_folder, exists, new_folder

SCHEMA = "term string, occurrences long, records long"


def term_deltas(changes: DataFrame, terms: str, sign: str) -> DataFrame:
    """(term, occurrences, records) of a batch of signed records; partial sums before the shuffle."""
    clean = F.filter(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    # in the sorted array an entry is the record's first of its term if it differs from its left neighbour
    new = lambda a, t, i: F.when(i == 0, True).otherwise(F.get(a, i - 1) != t)
    flagged = let(F.sort_array(clean), lambda a: F.transform(a, lambda t, i: F.struct(t.alias("term"), new(a, t, i).alias("first"))))
    return (
        changes.select(F.col(sign).cast("long").alias("__sign"), F.explode(flagged).alias("e"))
        .groupBy(F.col("e.term").alias("term"))
        .agg(F.sum("__sign").alias("occurrences"), F.sum(F.when(F.col("e.first"), F.col("__sign")).otherwise(F.lit(0))).alias("records"))
    )


def changes_between(old: DataFrame, new: DataFrame, key: str, terms: str) -> DataFrame:
    """(terms, sign) turning ``old`` into ``new``: added, changed and deleted records only.

    ``old`` and ``new`` are the records of the batch's keys before and after it, not the whole collection.
    """
    o = old.select(F.col(key).alias("__k"), F.col(terms).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(F.col(key).alias("__k"), F.col(terms).alias("__new"), F.lit(True).alias("__in_new"))
    both = o.join(n, "__k", "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    signed = F.array(
        F.struct(F.col("__old").alias("terms"), F.lit(-1).alias("sign")), F.struct(F.col("__new").alias("terms"), F.lit(1).alias("sign"))
    )
    return both.select(F.explode(signed).alias("e")).select("e.terms", "e.sign").where("terms IS NOT NULL")


def state_root(spark: SparkSession) -> str:
    """A new folder for state in the folder that all executors share."""
    return new_folder(spark, "term-counts")


class TermCounts:
    """Persistent counts under ``root``, in ``buckets`` partitions by the hash of the term."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifests = Manifests(spark, self.root)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, version: dict[str, str]) -> DataFrame:
        folders = [f"{self.root}/{v}/bucket={b}" for b, v in sorted(version.items())]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders)

    def version(self) -> dict[str, str]:
        """The folder of each bucket that holds a term."""
        return self.manifests.current()[1].get("version", {})

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of the current state."""
        return self._read(self.version())

    def apply(self, changes: DataFrame, batch: int, terms: str = "terms", sign: str = "sign") -> "TermCounts":
        """Merges the signed records of ``batch``; batches have growing numbers, and one up to the last that was applied changes nothing."""
        number, manifest = self.manifests.current()
        version = manifest.get("version", {})
        if batch <= manifest.get("batch", -1):
            return self
        folder, parts = f"v{number + 1:06d}-{uuid.uuid4().hex[:8]}", f"{self.root}/delta-{uuid.uuid4().hex}"
        delta = term_deltas(changes, terms, sign).where("occurrences != 0 OR records != 0")
        delta.withColumn("bucket", self._bucket(F.col("term"))).write.parquet(parts)
        delta = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(parts)
        touched = {str(r[0]) for r in delta.select("bucket").distinct().collect()}  # at most one row a bucket
        merged = (
            self._read({b: v for b, v in version.items() if b in touched})
            .unionByName(delta.drop("bucket"))
            .groupBy("term")
            .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            .where("occurrences != 0 OR records != 0")
        )
        merged.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        there = {b: folder for b in touched if exists(self.spark, f"{self.root}/{folder}/bucket={b}")}
        self.manifests.publish(number + 1, {"batch": batch, "version": {b: v for b, v in version.items() if b not in touched} | there})
        delete_folder(self.spark, parts)
        return self

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the folders that none of the last ``keep`` manifests names."""
        numbers = self.manifests.numbers()
        named = lambda some: {v for n in some for v in self.manifests.read(n)["version"].values()}
        for folder in named(numbers[:-keep]) - named(numbers[-keep:]):
            delete_folder(self.spark, f"{self.root}/{folder}")


def mark(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: rare, common, or null for useful terms."""
    return counts.withColumn(
        "mark",
        F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") > F.lit(common_above) * F.lit(n_records), F.lit("common")),
    )
