"""All queries of the core, with their SQL where SQL can express them."""

from __future__ import annotations

from marginalia.plans import notes, packed, streams, texts

MODULES = [notes, texts, streams, packed]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
