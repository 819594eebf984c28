"""Substring dedup: a relative Lempel-Ziv parse of every document against all indexed reference blocks.

The reference is the text that is new where it stands: documents in order of id, each window of `length` words that stands nowhere
earlier, be it in a document of lower id or further up in its own. Stretches of such windows are the reference blocks; together they hold
every window of the corpus once. So the longest match of a place is that of the one block that has its window, and a greedy parse from
left to right takes it: the factor goes on while text and block agree. At a factor's end, where text and block part, the next factor
is checked for from the last `length` - 1 words of this one on, so that a passage over two blocks isn't lost. Factors
of `length` words or more are duplicate spans, and their union is every word of a window that stands earlier.

To find each window's first place without shuffling all windows, texts are cut into content-defined pieces: a window takes the anchor of least hash among its
word 26-grams (for length 50), and neighbouring windows with one anchor form a piece. Equal windows have equal
anchors, so a piece meets every piece that could match it, and no others, under its anchor.

* Pieces whose anchor stands once match nothing. Where all pieces of an anchor are equal, all their
  windows are; the first piece has their first places.
* Where they differ, a copy begins or ends in one of them, and the windows of each distinct piece are looked up one by one.
  Their texts are read again for it, those of one document for each distinct piece.

Anchors are shuffled, a fourteenth as many as words; texts once more for the documents with boundaries. The least place of an anchor or window
is an aggregate, combined before the shuffle, and is joined back, so that no task holds all rows of a hot one.

Defined results: words are separated by ASCII white space and compared as they are, by hashes of 64 bits of all their bytes; documents without an id
are left out; null, empty and short texts have no factors; rows that share id and text are one document, and places are told apart by id and
position; the first occurrence is no duplicate; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import arrays as A
from lodestone.llm.names import col
from lodestone.llm.scratch import Scratch

LENGTH = 50


def _prefix(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the words' hashes, and the first word of each text."""
    start, end, first = A.words(data, off)
    return A.prefix_hash(A.word_hashes(data, start, end)), first


def least(key: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` neighbours."""
    have = 1
    while have * 2 <= size:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (size - have)], key[size - have :])


def blocks(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of every block: text, first window, number of windows, hash of its anchor, hash of its words."""
    prefix, first = _prefix(data, off)
    words, n = len(prefix) - 1, np.diff(first)
    gram = length // 2 + 1
    windows = np.maximum(n - length + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(words - gram + 1)
    h = A.span_hash(prefix, at, at + gram)
    key = least((h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), length - gram + 1)
    here = A.ragged(first[:-1], windows)
    doc = np.repeat(np.arange(len(n)), windows)
    anchor = (key[here] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(new, len(here)))
    begin, doc = here[new], doc[new]
    full = A.span_hash(prefix, begin, begin + count + length - 1)
    return doc, begin - first[:-1][doc], count, h[anchor[new]].view(np.int64), full.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = A.utf8(b.column(1))
        for i, j in A.chunks(off):
            doc, at, count, anchor, full = blocks(data[off[i] : off[j]], off[i : j + 1] - off[i], length)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + i)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(full)], ["doc_id", "at", "n", "anchor", "full"])

    return A.map_batches(docs, run, "doc_id long, at int, n int, anchor long, full long")


def window_hashes(docs: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """full, k, hash, doc_id and at of the windows of the blocks that lists has for each document."""
    rows = docs.join(lists, "doc_id").select("doc_id", "text", F.col("blocks.at"), F.col("blocks.n"), F.col("blocks.full"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = A.utf8(b.column(1))
        sizes = np.array([len(x) for x in b.column(2)], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        at, n, full = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4))
        for i, j in A.chunks(off):
            prefix, first = _prefix(data[off[i] : off[j]], off[i : j + 1] - off[i])
            part = slice(begins[i], begins[j])
            doc = np.repeat(np.arange(j - i), sizes[i:j])
            begin, count, name = first[:-1][doc] + at[part], n[part].astype(np.int64), full[part]
            # of rows that share an id, only the text that has the block
            fits = np.flatnonzero(begin + count + length - 1 <= first[1:][doc])
            fits = fits[A.span_hash(prefix, begin[fits], begin[fits] + count[fits] + length - 1).view(np.int64) == name[fits]]
            begin, count, name, doc, place = begin[fits], count[fits], name[fits], doc[fits], at[part][fits]
            w = A.ragged(begin, count)
            k = w - np.repeat(begin, count)
            h = A.span_hash(prefix, w, w + length).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(name, count)), pa.array(k.astype(np.int32)), pa.array(h), b.column(0).take(pa.array(np.repeat(doc, count) + i)), pa.array((np.repeat(place, count) + k).astype(np.int32))],
                ["full", "k", "hash", "doc_id", "at"],
            )

    return A.map_batches(rows, run, "full long, k int, hash long, doc_id long, at int")


def factors(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), ref_doc_id and ref_start_word of every factor."""
    disk = Scratch(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    place = F.struct("doc_id", "at")
    pieces = occurrences(texts, length)
    anchors = pieces.groupBy("anchor").agg(F.min(place).alias("ref"), F.max(place).alias("last"), F.min("full").alias("f0"), F.max("full").alias("f1"))
    anchors = anchors.filter("ref <> last").select("anchor", "ref", (F.col("f0") != F.col("f1")).alias("mixed"))
    met = disk.keep(pieces.join(anchors, "anchor").select("doc_id", "at", "n", "full", "ref", "mixed"), "repeated")
    whole = met.filter(~F.col("mixed") & (place != F.col("ref"))).select("doc_id", "at", "n", "ref")
    mixed = met.filter("mixed").select("doc_id", "at", "n", "full")
    distinct = mixed.groupBy("full").agg(F.min(place).alias("own"), F.max(place).alias("last"), F.first("n").alias("n"))
    lists = distinct.groupBy(F.col("own.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("own.at", "n", "full")).alias("blocks"))
    windows = disk.keep(window_hashes(texts, lists, length), "windows")
    found = windows.join(windows.groupBy("hash").agg(F.min(place).alias("ref")), "hash")
    known = found.join(distinct.select("full", (F.col("own") != F.col("last")).alias("copied")), "full").filter(F.col("copied") | (F.col("ref") != place))
    known = known.groupBy("full").agg(F.collect_set(F.struct("k", "ref")).alias("known"))
    edges = mixed.join(known, "full").select("doc_id", "at", F.explode("known").alias("x")).select("doc_id", (F.col("at") + F.col("x.k")).alias("at"), F.lit(1).alias("n"), F.col("x.ref").alias("ref"))
    edges = edges.filter(place != F.col("ref"))
    # the parse: windows in order; a factor goes on while place and reference move together
    order = Window.partitionBy("doc_id").orderBy("at")
    shift = F.col("ref.at") - F.col("at")
    goes_on = (F.lag("ref.doc_id").over(order) == F.col("ref.doc_id")) & (F.lag(shift).over(order) == shift) & (F.lag(F.col("at") + F.col("n")).over(order) >= F.col("at"))
    parsed = whole.union(edges).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("factor", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parsed.groupBy("doc_id", "factor").agg(
        F.min("at").alias("start_word"), (F.max(F.col("at") + F.col("n")) + (length - 1)).alias("end_word"), F.min("ref.doc_id").alias("ref_doc_id"), F.min("ref.at").alias("ref_start_word")
    ).drop("factor")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicate spans of all documents."""
    return factors(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE: dict[str, str] = {}
