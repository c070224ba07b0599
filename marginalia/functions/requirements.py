"""Whether a user's requirement says anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import ustrip

# Placeholders for "none", and the start words of the message state machine.
PLACEHOLDERS = ("none", "null", "nil", "nan", "n/a", "na", "undefined", "nothing", "无", "暂无", "没有", "空", "未填")
START_WORDS = ("开始", "start", "ok", "好")


def says_something(c: Column) -> Column:
    """False for null, blank, mere punctuation, placeholders and start words."""
    bare = F.lower(ustrip(c))
    nothing = bare.isin(*PLACEHOLDERS, *START_WORDS) | ~bare.rlike(r"[\p{L}\p{N}]")
    return F.coalesce(~nothing, F.lit(False))
