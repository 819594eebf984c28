"""Tokens and terms of text attributes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import ColumnLike, col
from lodestone.functions.stemmers import language_name, stemmer


#: The characters that Unicode calls white space, as a class; much faster to match than by their property.
WHITE_SPACE = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def tokens(text: ColumnLike) -> Column:
    """The parts between Unicode white space, punctuation kept; null gives no tokens."""
    parts = F.split(F.coalesce(col(text).cast("string"), F.lit("")), WHITE_SPACE)
    return F.filter(parts, lambda t: t != "")


def lower_tokens(text: ColumnLike) -> Column:
    return tokens(F.lower(col(text)))


def stems(words: ColumnLike, language: ColumnLike) -> Column:
    """The stems of an array of lower-case words, for a language's name or code in each row (null and unknown: English)."""

    @F.arrow_udf("array<string>")
    def of(words: pa.Array, language: pa.Array) -> pa.Array:
        return stem_lists(words, language)

    return of(col(words), col(language))


def stem_lists(words: pa.Array, language: pa.Array) -> pa.Array:
    """The stems of lists of words; each language's different words are stemmed once, and no others become Python's."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded, languages = words.flatten().dictionary_encode(), language.dictionary_encode()
    places = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    names = [language_name(x) for x in (*languages.dictionary.to_pylist(), None)]  # null: English
    of_word = np.repeat(pc.fill_null(languages.indices, len(names) - 1).to_numpy(zero_copy_only=False), sizes)
    found, out = [], np.zeros(len(places), np.int64)
    count = 0
    for i, name in enumerate(names):
        mine = np.flatnonzero(of_word == i)
        if not len(mine):
            continue
        different, at = np.unique(places[mine], return_inverse=True)
        stem = stemmer(name)
        found.append(pa.array([None if w is None else stem(w) for w in coded.dictionary.take(pa.array(different[different < len(coded.dictionary)])).to_pylist()] + [None] * int((different == len(coded.dictionary)).sum()), pa.string()))
        out[mine] = at + count
        count += len(different)
    values = pa.concat_arrays(found).take(pa.array(out)) if found else pa.array([], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values, mask=words.is_null())


def text_terms(text: ColumnLike, language: ColumnLike) -> Column:
    """The distinct stems of a text's tokens, sorted."""
    return F.array_sort(F.array_distinct(stems(F.array_distinct(lower_tokens(text)), language)))


def keyword_terms(value: ColumnLike) -> Column:
    """A keyword is one term, as it is."""
    return F.when(col(value).isNull(), F.array().cast("array<string>")).otherwise(F.array(col(value).cast("string")))


def term_key(attribute: str, term: ColumnLike) -> Column:
    return F.concat_ws(":", F.lit(attribute), col(term))


def query_terms(value: str, language: str | None) -> list[str]:
    """What a query's text is matched by: the distinct stems of its tokens."""
    stem = stemmer(language)
    return list(dict.fromkeys(stem(t) for t in value.lower().split()))
