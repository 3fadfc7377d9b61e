"""Queries and SQL of the numbered operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "url_filter", "ann", "jaccard", "tiff", "token_counts", "language_id", "packing", "suffix_dedup", "secrets", "conversation_repair", "spelling", "multi_index")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"gridpoint.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
