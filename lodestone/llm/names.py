"""Columns by any name, and names of one's own that clash with none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
