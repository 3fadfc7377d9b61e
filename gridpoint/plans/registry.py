"""Queries of the table reader by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("reading", "branches", "gating", "assembling", "generating")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"gridpoint.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
