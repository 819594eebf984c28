"""Term indexes: postings (keys, term) of text and keyword attributes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stemmers import language_name
from lodestone.functions.text import lower_tokens, stems


def terms_of(docs: DataFrame, path: str, language: str | Column | None = "none") -> DataFrame:
    """docs with `terms_<path>`: the distinct tokens of the attribute in lower case, stemmed unless the language is "none"; a keyword (language None) is one term."""
    if language is None:
        found = F.when(F.col(path).isNotNull(), F.array(F.col(path).cast("string"))).otherwise(F.array().cast("array<string>"))
    elif isinstance(language, str) and language_name(language) == "none":
        found = F.array_distinct(lower_tokens(path))
    else:
        found = F.array_distinct(stems(F.array_distinct(lower_tokens(path)), F.lit(language) if isinstance(language, str) else language))
    return docs.withColumn(f"terms_{path}", found)


def postings(docs: DataFrame, paths: Sequence[str], keys: Sequence[str] = ("doc_id",), only: Iterable[str] | None = None) -> DataFrame:
    """The distinct (keys, term) of docs with `terms_<path>` columns; with `only`, those of these terms.

    A document's terms are distinct already, so that only documents that share their keys need a shuffle; the keys alone are read to see.
    """
    terms = F.concat(*(_named(p) for p in paths))
    if only is not None:
        terms = F.array_intersect(terms, F.array(*map(F.lit, sorted(only))).cast("array<string>"))
    rows = docs.select(*keys, F.explode(terms).alias("term"))
    plain = not any(":" in p for p in paths) and len(set(paths)) == len(paths)
    return rows if plain and docs.groupBy(*keys).count().filter("count > 1").isEmpty() else rows.distinct()


def _named(path: str) -> Column:
    return F.transform(f"terms_{path}", lambda t: F.concat_ws(":", F.lit(path), t))


def term_statistics(index: DataFrame, key: str = "doc_id") -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("n_docs"), F.min(key).alias("first_doc"), F.max(key).alias("last_doc"))
