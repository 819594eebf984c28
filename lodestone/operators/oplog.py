"""Operation logs as DataFrames: (seq, op, user_id, doc_id, ...), where op is "insert" or "delete".

An insert is live at a sequence number if no delete of its (user, document) up to there has a higher one. seq
alone orders; rows may arrive in any order. Everything here is one shuffle by (user, document), or less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("user_id", "doc_id")


def until(ops: DataFrame, seq: int | Column | None) -> DataFrame:
    return ops if seq is None else ops.filter(F.col("seq") <= seq)


def live(ops: DataFrame, at: int | None = None) -> DataFrame:
    """All inserts that no later delete undid, copies of a document included."""
    deleted = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(*KEY))
    rows = until(ops, at).withColumn("__deleted", deleted)
    return rows.filter((F.col("op") == "insert") & (F.col("__deleted").isNull() | (F.col("__deleted") < F.col("seq")))).drop("__deleted", "op")


def last_per(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each group the row of highest seq."""
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def latest(ops: DataFrame, at: int | None = None) -> DataFrame:
    """The current state: of each (user, document) its last insert, if it is live."""
    return last_per(live(ops, at), KEY)


def without(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows (user_id, doc_id, seq) that no tombstone of higher seq names, as an anti-join."""
    gone = tombstones.groupBy(*KEY).agg(F.max("seq").alias("__deleted"))
    both = [rows[k] == gone[k] for k in KEY]
    return rows.join(gone, [*both, rows["seq"] < gone["__deleted"]], "left_anti")


def segment_rows(ops: DataFrame, size: int) -> DataFrame:
    """Inserts in segments of `size` operations; within a segment the last insert of a document wins, and a delete within it counts."""
    cut = ops.withColumn("segment", F.floor(F.col("seq") / size).cast("long"))
    return last_per(cut, ["segment", *KEY]).filter("op = 'insert'").drop("op")


def segment_stats(ops: DataFrame, size: int) -> DataFrame:
    """segment, docs, live and deleted_ratio."""
    rows = segment_rows(ops, size)
    alive = without(rows, ops.filter("op = 'delete'").select(*KEY, "seq")).groupBy("segment").agg(F.count("*").alias("live"))
    out = rows.groupBy("segment").agg(F.count("*").alias("docs")).join(alive, "segment", "left")
    return out.select("segment", "docs", F.coalesce("live", F.lit(0)).alias("live"), (1 - F.coalesce("live", F.lit(0)) / F.col("docs")).alias("deleted_ratio"))


def merge_candidates(stats: DataFrame, most: int) -> DataFrame:
    """The smallest segments, to be merged into one so that `most` are left; none if there aren't more."""
    n = stats.agg(F.count("*").alias("__n"))
    order = F.row_number().over(Window.orderBy("docs", "segment"))  # a row for each segment
    return stats.withColumn("__r", order).crossJoin(F.broadcast(n)).filter((F.col("__n") > most) & (F.col("__r") <= F.col("__n") - (most - 1))).drop("__r", "__n")


def merge(ops: DataFrame, size: int, segments: DataFrame) -> DataFrame:
    """The one segment that replaces these: their live rows, the last of each document."""
    rows = segment_rows(ops, size).join(segments.select("segment"), "segment", "left_semi")
    return last_per(without(rows, ops.filter("op = 'delete'").select(*KEY, "seq")), KEY).drop("segment")


def histogram(rows: DataFrame, value: str, start: float = 0.001, factor: float = 2.0, buckets: int = 10) -> DataFrame:
    """Counts at or below each exponential bound, and of all as bound infinity (null)."""
    bounds = [start * factor**i for i in range(buckets)]
    counts = rows.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("bound"), F.col("all").alias("n")))
    return counts.select(F.inline(pairs))
