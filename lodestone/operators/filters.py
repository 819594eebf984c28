"""The filter language: And, Or, Contains, NotContains, Ids and DocIds.

A filter becomes a column over documents that carry an array of terms for each attribute (`condition`), or a
DataFrame of matching documents from a table of postings (`matches`). Empty And, empty Or and no filter at all match nothing, as
do Contains without tokens and with a term that no document has. NotContains matches what Contains doesn't.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms


@dataclass(frozen=True)
class Schema:
    """Attributes: "keyword", or "text" with a language for each document's or the attribute's own."""

    keywords: frozenset[str] = frozenset()
    languages: dict[str, str] = field(default_factory=dict)

    def terms(self, path: str, value: str) -> list[str]:
        return [value] if path in self.keywords else query_terms(value, self.languages.get(path))


@dataclass(frozen=True)
class Contains:
    path: str
    value: str


@dataclass(frozen=True)
class NotContains:
    path: str
    value: str


@dataclass(frozen=True)
class Ids:
    """Row numbers within (user, segment), from 0."""

    ids: tuple[int, ...]


@dataclass(frozen=True)
class DocIds:
    ids: tuple[int, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Filter = And | Or | Contains | NotContains | Ids | DocIds | None


def terms_column(path: str) -> Column:
    return F.col(f"terms_{path}")


def condition(f: Filter, schema: Schema = Schema(), doc_id: str = "doc_id", point_id: str = "point_id") -> Column:
    """The filter over a table with `terms_<path>` arrays. It has no joins, so the scan evaluates it."""
    match f:
        case Contains(path, value):
            wanted = schema.terms(path, value)
            if not wanted:
                return F.lit(False)
            return F.coalesce(reduce(Column.__and__, (F.array_contains(terms_column(path), t) for t in wanted)), F.lit(False))
        case NotContains(path, value):
            return ~condition(Contains(path, value), schema, doc_id, point_id)
        case Ids(ids):
            return F.coalesce(F.col(point_id).isin(list(ids)), F.lit(False)) if ids else F.lit(False)
        case DocIds(ids):
            return F.coalesce(F.col(doc_id).isin(list(ids)), F.lit(False)) if ids else F.lit(False)
        case And(parts) if parts:
            return reduce(Column.__and__, (condition(p, schema, doc_id, point_id) for p in parts))
        case Or(parts) if parts:
            return reduce(Column.__or__, (condition(p, schema, doc_id, point_id) for p in parts))
    return F.lit(False)


def used_terms(f: Filter, schema: Schema) -> set[str]:
    match f:
        case Contains(path, value) | NotContains(path, value):
            return {f"{path}:{t}" for t in schema.terms(path, value)}
        case And(parts) | Or(parts):
            return set().union(*(used_terms(p, schema) for p in parts)) if parts else set()
    return set()


def matches(f: Filter, postings: DataFrame, everything: DataFrame, schema: Schema = Schema(), keys: Iterable[str] = ("doc_id",), point_id: str = "point_id") -> DataFrame:
    """The keys of matching documents, from postings (keys, term); `everything` has the keys of all documents, for NotContains and ids.

    Only postings of the filter's own terms are read, once, and grouped once: each document's set of those terms decides.
    """
    keys = list(keys)
    wanted = sorted(used_terms(f, schema))

    def over_sets(g: Filter) -> Column:
        match g:
            case Contains(path, value):
                terms = schema.terms(path, value)
                return reduce(Column.__and__, (F.array_contains("__terms", f"{path}:{t}") for t in terms)) if terms else F.lit(False)
            case NotContains(path, value):
                return ~over_sets(Contains(path, value))
            case And(parts) if parts:
                return reduce(Column.__and__, map(over_sets, parts))
            case Or(parts) if parts:
                return reduce(Column.__or__, map(over_sets, parts))
            case Ids() | DocIds():
                return condition(g, schema, keys[-1], point_id)
        return F.lit(False)

    sets = postings.filter(F.col("term").isin(wanted)).groupBy(*keys).agg(F.collect_set("term").alias("__terms"))
    if not _beyond_terms(f):
        return sets.filter(over_sets(f)).select(*keys)
    both = everything.join(sets, keys, "left").withColumn("__terms", F.coalesce("__terms", F.array().cast("array<string>")))
    return both.filter(over_sets(f)).select(*keys)


def _beyond_terms(f: Filter) -> bool:
    """Whether documents without any of the filter's terms could match."""
    match f:
        case NotContains() | Ids() | DocIds():
            return True
        case And(parts) | Or(parts):
            return any(map(_beyond_terms, parts))
    return False


def restrict(candidates: list[int], matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """The matched documents among the candidates; no candidates mean no restriction."""
    return matched.filter(F.col(key).isin(candidates)) if candidates else matched
