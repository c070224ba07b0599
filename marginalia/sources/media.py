"""Audio and video files as a table, and how each would be transcribed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import DIRECT_AUDIO_BYTES, SEGMENT_SECONDS, SPEECH_API_BYTES


def read_media(spark: SparkSession, path: str, pattern: str = "*.mp3") -> DataFrame:
    """(path, modified, length) of the files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def route(length: Column, direct_failed: Column | None = None) -> Column:
    """direct, speech or segments: by size, and by whether the direct way failed."""
    failed = F.coalesce(direct_failed, F.lit(False)) if direct_failed is not None else F.lit(False)
    return F.when((length <= DIRECT_AUDIO_BYTES) & ~failed, "direct").when(failed & (length <= SPEECH_API_BYTES), "speech").otherwise("segments")


def segments(df: DataFrame, key: str, seconds: str, step: int = SEGMENT_SECONDS) -> DataFrame:
    """(key, seg, seg_start, seg_end) of recordings cut into ``step`` seconds; none for an unknown or zero length."""
    n = F.ceil(F.col(seconds) / step).cast("int")
    known = df.where((F.col(seconds) > 0) & ~F.isnan(F.col(seconds).cast("double")))
    one = known.select(key, F.col(seconds).cast("double").alias("__s"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seg"))
    return one.select(key, "seg", (F.col("seg") * step).cast("double").alias("seg_start"), F.least((F.col("seg") + 1) * F.lit(float(step)), F.col("__s")).alias("seg_end"))
