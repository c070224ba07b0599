"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20


def bounded_side(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, bool]:
    """``df`` as a broadcast side if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else unchanged.

    At most ``max_rows + 1`` rows reach the driver, as Arrow columns. Beyond the bound the caller's join
    runs as a shuffle join, whose skewed partitions adaptive execution splits; ``df`` is then
    computed again, so what is dear to compute should be written first.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True
