"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

PARTS = ("algorithm_queries", "text_queries")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for part in PARTS:
    module = import_module(f"marginalia.llm.{part}")
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
