"""Reading times written in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = (
    r"^\s*(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?"
    r"(?:[T\s]*(\d{1,2})[:：时](\d{1,2})(?:[:：分](\d{1,2}(?:\.\d{1,9})?)秒?)?)?"
    r"\s*(?:(Z|z|UTC|GMT)?\s*(?:([+-])(\d{1,2}):?(\d{2})?)?)?\s*$"
)
_EPOCH = r"^\s*(\d{9,10}|\d{13}|\d{16})(?:\.\d+)?\s*$"


def epoch_micros(c: Column, default_offset_minutes: int = 480) -> Column:
    """Microseconds since 1970 of a time as text; null if it is no time.

    Year-month-day notations with -, /, . or 年月日, with or without a time of day, and
    epoch seconds, milliseconds and microseconds. A time without a zone is at
    ``default_offset_minutes`` east of UTC. Impossible dates are no times.
    """
    part = lambda i: F.regexp_extract(c, _DATE, i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    utc = F.try_make_timestamp(
        part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int"), number(4), number(5),
        F.coalesce(part(6).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)")), F.lit("UTC"),
    )
    named = number(9) * 60 + number(10)
    offset = (
        F.when(part(8) == "-", -named).when(part(8) == "+", named).when(part(7) != "", F.lit(0)).otherwise(F.lit(default_offset_minutes))
    )
    dated = F.unix_micros(utc) - offset.cast("long") * F.lit(60_000_000)
    raw = F.regexp_extract(c, _EPOCH, 1)
    digits = F.length(raw)
    epoch = raw.try_cast("long") * F.when(digits <= 10, F.lit(1_000_000)).when(digits == 13, F.lit(1_000)).otherwise(F.lit(1)).cast("long")
    return F.coalesce(dated, epoch)


def local_stamp(ts: Column, offset_minutes: int = 480) -> Column:
    """A time as text to the second, ``offset_minutes`` east of UTC; the offset is fixed, no zone's rules apply."""
    return F.date_format(ts.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(offset_minutes)), "yyyy-MM-dd HH:mm:ss")
