from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "ids", "n_lines", "slot", "group_id", "n_tokens", "toxic", "rank", "block", "key", "drop", "__drop", "__kept", "__key", "__lines", "found", "gone", "h", "k", "a.b", "x`y", "mixed_id")


def awkward_rows() -> list[tuple]:
    long = "der lange Text, " * 20000
    texts = [(1, "you idiot, you moron"), (1, "you idiot, you moron"), (None, "no id at all"), (None, None), (2, None), (3, ""), (4, long), (5, "\n\n \n"), (6, "über 😀 ▁ \x00 end"), (7, "a"), (8, "x y z " * 30)]
    return [(i, t, None if k % 3 else "de", None if k % 4 == 0 else f"src{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), DOCUMENTS)
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
