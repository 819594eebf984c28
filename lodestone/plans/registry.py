"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("lodestone.plans.vector", "lodestone.plans.terms", "lodestone.plans.index", "lodestone.plans.state")


def _gather(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(m), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
