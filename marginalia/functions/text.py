"""Scalar text helpers as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Characters that print nothing and count as blanks at the edges of a value.
BLANK = r"\s\p{Z}​‌‍⁠﻿\x00-\x1f"


def ustrip(c: Column) -> Column:
    """Trim Unicode white space and zero-width characters at both ends."""
    return F.regexp_replace(c, rf"(?U)^[{BLANK}]++|[{BLANK}]++$", "")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, the case rule of the store's LIKE."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)
