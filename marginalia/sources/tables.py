"""Parquet tables of one directory, read with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schema import TABLES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir`` (a file or a directory of part files); those of the domain by their schema."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_host(url: Column) -> Column:
    """Lower-cased host of a URL; null and host-less URLs give the empty string."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.coalesce(host, F.lit(""))
