"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("op01_repetition", "op02_sentencepiece", "op03_toxicity", "op04_line_dedup", "op05_html", "op06_ann", "op07_secrets", "op08_substring", "op09_mixing", "op10_minhash")


def _gather(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"lodestone.llm.{m}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
