"""Quality rules on repetition: suffix arrays and their longest-common-prefix intervals.

A text is judged by its own repeated substrings of at least `min_length` characters:

1. A rolling hash of every window of `min_length` characters leaves only the windows that occur
   again in the same text: no other place can begin such a repeat. Hash collisions leave a few too
   many, never too few.
2. What those windows cover, put together with a separator of its own after each stretch, gets a
   suffix array by prefix doubling, all texts of a chunk at once. The longest common prefixes of neighbours are found
   bit by bit with hashes of spans, a strip of neighbours at a time. A text is worked on whole, with
   some 80 bytes a character where all of it repeats.
3. The suffix at place i of the array lies in the LCP intervals above it; the deepest has the length
   max(lcp[i], lcp[i+1]) and holds the longest repeat that starts there. Every maximal repeat is
   an LCP interval, its occurrences start at suffixes of that interval, and a deeper interval only covers more: the
   union of the deepest spans is the union over all maximal repeats.
4. The fraction of characters in the union and the longest repeat are limited.

Occurrences may overlap ("aaaa" repeats "aaa"). Defined results: a null or empty text, or one not
longer than `min_length`, has no repeat and is kept; each input row gives one row (repeated rows and
null ids too); other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.names import col

MIN_LENGTH, MAX_FRACTION, MAX_LONGEST = 50, 0.7, 1000
STRIP = 1 << 18  # windows or neighbours worked on together
SCHEMA = "doc_id long, n_chars long, covered_chars long, longest_repeat long"


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of int64 codes, and lcp[i] of suffixes i-1 and i of it (lcp[0] = 0)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = np.int32 if n < 1 << 31 else np.int64

    def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, small)
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])), dtype=small)
        return order, rank

    order, rank = ranks(codes)
    step = 1
    while rank[order[-1]] + 1 < n and step < n:
        del order
        key = rank.astype(np.int64)
        key *= n + 1
        key[:-step] += rank[step:]
        key[:-step] += 1
        order, rank = ranks(key)
        del key
        step *= 2
    del rank
    order = order.astype(small)
    # the longest common prefixes of neighbours, bit by bit from the top, by the hashes of spans
    prefix, lcp = A.prefix_hash(A.mix(codes.view(np.uint64))), np.zeros(n, small)
    for i in range(1, n, STRIP):
        x, y = order[i - 1 : min(i + STRIP, n) - 1].astype(np.int64), order[i : i + STRIP].astype(np.int64)
        room, have = n - np.maximum(x, y), np.zeros(len(x), np.int64)
        for k in range(n.bit_length() - 1, -1, -1):
            fits = np.flatnonzero(have + (1 << k) <= room)
            p, q = x[fits] + have[fits], y[fits] + have[fits]
            same = A.span_hash(prefix, p, p + (1 << k)) == A.span_hash(prefix, q, q + (1 << k))
            have[fits[same]] += 1 << k
        lcp[i : i + STRIP] = have
    return order, lcp


def _candidates(codes: np.ndarray, chars: np.ndarray, min_length: int) -> np.ndarray:
    """Places of the windows of min_length characters that occur again in the same text, ascending."""
    room = np.maximum(np.diff(chars) - min_length + 1, 0)
    ends = np.cumsum(room)
    if not len(ends) or ends[-1] < 2:
        return np.zeros(0, np.int64)
    prefix = A.prefix_hash(A.mix(codes.astype(np.uint64) + np.uint64(1)))
    bits = np.uint64(max(1, len(codes).bit_length()))
    key = np.empty(int(ends[-1]), np.uint64)
    for i in range(0, len(key), STRIP):
        at = np.arange(i, min(i + STRIP, len(key)))
        doc = np.searchsorted(ends, at, "right")
        at += chars[doc] - (ends[doc] - room[doc])
        h = A.mix(A.span_hash(prefix, at, at + min_length) + doc.astype(np.uint64) * A.BASE)
        key[i : i + STRIP] = (h >> bits << bits) | at.astype(np.uint64)
    del prefix
    key.sort()
    again = (key[1:] >> bits) == (key[:-1] >> bits)
    hit = np.append(again, False)
    hit[1:] |= again
    at = (key[hit] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at.sort()
    return at


def measure(data: np.ndarray, off: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, characters covered by repeats and the longest repeat of every text."""
    codes, chars = A.characters(data, off)
    n, docs = len(codes), len(off) - 1
    lengths, covered, longest = np.diff(chars), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    at = _candidates(codes, chars, min_length)
    if not len(at):
        return lengths, covered, longest
    # stretches of the text that candidate windows of one document cover
    owner = np.searchsorted(chars, at, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (at[1:] > at[:-1] + min_length) | (owner[1:] != owner[:-1]))))
    low = at[first]
    high = at[np.concatenate((first[1:] - 1, [len(at) - 1]))] + min_length
    size, owner = high - low, owner[first]
    del at, first
    begins = np.cumsum(size + 1) - size - 1  # where each stretch begins in what follows; one separator after each
    flat = np.empty(int((size + 1).sum()), np.int64)
    for k, (a, e, to, who) in enumerate(zip(low.tolist(), high.tolist(), begins.tolist(), owner.tolist())):
        flat[to : to + e - a] = codes[a:e]
        flat[to : to + e - a] |= who << 22
        flat[to + e - a] = -1 - k
    order, lcp = suffix_array(flat)
    del flat
    best = np.maximum(lcp, np.append(lcp[1:], 0))
    deep = np.flatnonzero(best >= min_length)
    place, span = order[deep].astype(np.int64), best[deep].astype(np.int64)
    del order, lcp, best, deep
    if not len(place):
        return lengths, covered, longest
    body = np.searchsorted(begins, place, "right") - 1
    begin = place - begins[body] + low[body]
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + span, minlength=n + 1)
    sums = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    np.maximum.at(longest, owner[body], span)
    return lengths, sums[chars[1:]] - sums[chars[:-1]], longest


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, n_chars, covered_chars, covered_fraction, longest_repeat and keep, for each row of docs."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = A.utf8(b.column(1))
        for i, j in A.chunks(off):
            found = measure(data[off[i] : off[j]], off[i : j + 1] - off[i], min_length)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, found)], ["doc_id", "n_chars", "covered_chars", "longest_repeat"])

    rows = A.map_batches(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")), run, SCHEMA)
    fraction = F.when(F.col("n_chars") > 0, F.col("covered_chars") / F.col("n_chars")).otherwise(F.lit(0.0))
    return rows.withColumn("covered_fraction", fraction).withColumn("keep", (F.col("covered_fraction") <= max_fraction) & (F.col("longest_repeat") <= max_longest))


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, with their figures."""
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("keep")


QUERIES = {"op1_suffix_repetition": op1_suffix_repetition}
ORACLE: dict[str, str] = {}
