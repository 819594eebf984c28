"""Exact nearest-neighbour and term search, as DataFrame plans.

Results are ordered by score, then document id; NaN scores come last. Top-k over everything becomes
TakeOrderedAndProject, top-k for each query a WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.columns import vector
from lodestone.functions.distance import METRICS, Metric, distance
from lodestone.functions.nearest import Nearest, matrix

#: Queries that a task holds at once: 20 bytes for each dimension of each, and 24 for each of its k best.
BLOCK = 1 << 16


def top_k(docs: DataFrame, query: Sequence[float], k: int, metric: Metric = "l2", where: Column | None = None, doc_id: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """The k closest documents: all columns but the vector, and score."""
    if where is not None:
        docs = docs.filter(where)
    scored = docs.withColumn("score", distance(vector_col, vector(list(query)), metric)).drop(vector_col)
    return scored.orderBy(F.col("score").asc(), F.col(doc_id).asc()).limit(k)


def within(docs: DataFrame, query: Sequence[float], radius: float, metric: Metric = "l2", vector_col: str = "vector") -> DataFrame:
    return docs.withColumn("score", distance(vector_col, vector(list(query)), metric)).drop(vector_col).filter(F.col("score") <= radius)


def best(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), doc_id: str = "doc_id") -> DataFrame:
    """The k best rows of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").asc(), F.col(doc_id).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_batch(docs: DataFrame, queries: DataFrame, k: int, metric: Metric = "l2", doc_id: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """query_id, doc_id, score and rank of the k closest documents of each query (query_id, vector)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(vector_col).alias("vector"))
    return best(near_pairs(queries.select("query_id", "vector"), docs, k, metric), k)


def near_pairs(queries: DataFrame, docs: DataFrame, k: int, metric: Metric, by: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """by, query_id, doc_id and score: for each query (by, query_id, vector), of the documents (by, doc_id, vector) of the same `by`, the k best and others.

    Queries and documents are cut into blocks, and each pair of blocks is one task's: it holds BLOCK queries, over which the
    documents pass in the order of their ids. Of what grows with the tables, a task holds the documents' ids alone. `most`: no `by` has more queries.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric}: no such distance; there are {', '.join(METRICS)}")
    single = all(d.schema["vector"].dataType.simpleString() == "array<float>" for d in (queries, docs))
    kind = "array<float>" if single else "array<double>"
    # each `by` makes tasks already; without it, blocks alone do
    least = 2 if by else 8
    cut = [max(-(-n // BLOCK), min(least, -(-n // 1024)), 1) for n in (queries.count() if most is None else most, least * BLOCK if by else docs.count())]
    ids = [queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    names = [*by, "__q", "__d", "__side", "query_id", "doc_id", "vector"]

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("__q", block("query_id", cut[0])).withColumn("__d", every(cut[1])).withColumn("__side", F.lit(0)).withColumn("doc_id", F.lit(None).cast(ids[1]))
    right = docs.withColumn("__q", every(cut[0])).withColumn("__d", block("doc_id", cut[1])).withColumn("__side", F.lit(1)).withColumn("query_id", F.lit(None).cast(ids[0]))
    both = left.withColumn("vector", F.col("vector").cast(kind)).select(names).union(right.withColumn("vector", F.col("vector").cast(kind)).select(names))
    key = [*by, "__q", "__d"]
    tasks = 3 * cut[0] * cut[1] * (8 if by else 1)
    rows = both.repartition(tasks, *key).sortWithinPartitions(*key, "__side", "doc_id")
    out = [*by, "query_id", "doc_id", "score"]

    def results(found: Nearest, key: tuple, kinds: list[pa.DataType], asked: pa.Array, named: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        named = pa.concat_arrays(named)
        for row, place, score in found.found():
            own = [pa.array([v] * len(row), t) for v, t in zip(key, kinds)]
            yield pa.RecordBatch.from_arrays([*own, asked.take(pa.array(row)), named.take(pa.array(place)), pa.array(score)], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, near, named = None, [], None, []
        for b in batches:
            for part in _runs(b, len(key)):
                this = tuple(c[0].as_py() for c in part.columns[: len(key)])
                if this != now:
                    if near:
                        yield from results(near, now, kinds, asked, named)
                    now, asked, near, named = this, [], None, []
                    kinds = [c.type for c in part.columns[: len(by)]]
                first = int(np.count_nonzero(part.column(len(key)).to_numpy() == 0))
                if first:
                    asked.append(part.slice(0, first))
                if first < part.num_rows and len(asked):
                    if near is None:
                        near = Nearest(matrix(pa.concat_arrays([a.column(len(key) + 3) for a in asked])), k, metric)
                        asked = pa.concat_arrays([a.column(len(key) + 1) for a in asked])
                    rest = part.slice(first)
                    near.add(matrix(rest.column(len(key) + 3)))
                    named.append(rest.column(len(key) + 2))
        if near:
            yield from results(near, now, kinds, asked, named)

    kinds_sql = [f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*by).schema.fields]
    return rows.mapInArrow(run, ", ".join([*kinds_sql, f"query_id {ids[0]}", f"doc_id {ids[1]}", "score double"]))


def _runs(b: pa.RecordBatch, keys: int) -> Iterator[pa.RecordBatch]:
    """The stretches of rows that agree in the first columns."""
    if not b.num_rows:
        return
    new = np.zeros(b.num_rows - 1, bool)
    for c in b.columns[:keys]:
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
    for a, z in zip(edges, edges[1:]):
        yield b.slice(a, z - a)


def top_k_users(docs: DataFrame, query: Sequence[float], k: int, users: Sequence, metric: Metric = "l2") -> DataFrame:
    """The k closest documents of all these users together. A document that several of them own counts once."""
    scored = docs.filter(F.col("user_id").isin(list(users))).select("doc_id", distance("vector", vector(list(query)), metric).alias("score"))
    return scored.groupBy("doc_id").agg(F.min("score").alias("score")).orderBy("score", "doc_id").limit(k)


def top_k_each_user(docs: DataFrame, query: Sequence[float], k: int, metric: Metric = "l2") -> DataFrame:
    return best(docs.select("user_id", "doc_id", distance("vector", vector(list(query)), metric).alias("score")), k, ("user_id",))


def term_search(matched: DataFrame, limit: int | None, doc_id: str = "doc_id") -> DataFrame:
    """The lowest distinct ids of the matched documents; all of them if limit is None."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    found = matched.select(doc_id).distinct().orderBy(doc_id)
    return found if limit is None else found.limit(limit)


def gather(shards: Sequence[DataFrame], k: int) -> DataFrame:
    """The k best of the shards' results (doc_id, score), ascending."""
    out = shards[0].select("doc_id", "score")
    for s in shards[1:]:
        out = out.unionByName(s.select("doc_id", "score"))
    return out.orderBy("score", "doc_id").limit(k)
