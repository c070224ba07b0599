"""The store's LIKE: ASCII-only case folding, % and _ as wildcards, no escape character."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(c: Column, keyword: str, literal: bool = False) -> Column:
    """Whether ``c`` is LIKE %keyword%. Null gives null; ``literal`` takes % and _ as themselves."""
    if keyword == "":
        return c.isNotNull()
    plain = literal or not re.search("[%_]", keyword)
    if plain and not re.search("[A-Za-z]", keyword):
        return c.contains(keyword)  # reaches the Parquet scan
    wild = {} if plain else {"%": ".*", "_": "."}
    # a case-insensitive Java expression without the Unicode flag folds ASCII letters only
    return c.rlike("(?is)" + "".join(wild.get(ch) or (r"\\" if ch == "\\" else rf"\Q{ch}\E" if not ch.isalnum() else ch) for ch in keyword))


def split_keywords(query: str) -> list[str]:
    """Keywords of a query: commas and white space separate."""
    return re.sub("[,，]", " ", query).split()


def keywords_column(query: Column) -> Column:
    """``split_keywords`` as a column expression."""
    return F.filter(F.split(F.regexp_replace(query, "[,，]", " "), r"(?U)\s+"), lambda k: k != "")
