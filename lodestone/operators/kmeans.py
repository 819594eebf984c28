"""K-means on DataFrames: Lloyd's iterations with a penalty for large clusters, repair of empty ones, and splitting of long lists.

An iteration is one pass: each batch of vectors meets the centroids in numpy and gives sums and counts, which are added up by cluster. Only
centroids, k of them, are on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.nearest import matrix, nearest_label
from lodestone.operators.ann import cluster_count
from lodestone.sources.workspace import stored


def sample(docs: DataFrame, n: int, doc_id: str = "doc_id") -> DataFrame:
    """n documents without replacement, the same at each call: those of least hash."""
    return docs.orderBy(F.xxhash64(doc_id), doc_id).limit(n)


def costs(x: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    d = np.zeros((len(x), len(centroids)))
    for j in range(x.shape[1]):  # in the order of dimensions, for results that don't depend on batches
        d += (x[:, j, None] - centroids[None, :, j]) ** 2
    return d + penalty * sizes[None, :]


def labels(docs: DataFrame, centroids: np.ndarray, sizes: np.ndarray | None = None, penalty: float = 0.0, doc_id: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """doc_id, label and cost of the cheapest centroid; the lower label wins ties."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(vector_col).alias("vector"))
    return _tagged(rows, centroids, None if sizes is None else penalty * sizes).select("doc_id", "label", "cost")


def _tagged(rows: DataFrame, centroids: np.ndarray, extra: np.ndarray | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """rows (doc_id, vector) with label and cost, in one pass; with `only`, those of these labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, cost = nearest_label(matrix(b.column(1)), centroids, extra)
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(cost)], ["doc_id", "vector", "label", "cost"])
                yield out if only is None else out.filter(pa.array(np.isin(at, only)))

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "label int, cost double"]))


def _sizes(rows: DataFrame, centroids: np.ndarray) -> dict[int, int]:
    """How many of rows (vector) each label has, where it has any: only counts leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                count += np.bincount(nearest_label(matrix(b.column(0)), centroids)[0], minlength=len(count))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(count[seen])], ["label", "n"])

    return {r.label: r.n for r in rows.mapInArrow(run, "label int, n long").groupBy("label").agg(F.sum("n").alias("n")).collect()}


def _step(rows: DataFrame, centroids: np.ndarray, sizes: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, list]:
    """Sums and counts of the clusters, and of each the farthest vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, far = np.zeros((k, dim)), np.zeros(k, np.int64), [(-1.0, None)] * k
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0))
            at, _ = nearest_label(x, centroids, penalty * sizes)
            np.add.at(total, at, x)
            count += np.bincount(at, minlength=k)
            own = ((x - centroids[at]) ** 2).sum(1)
            order = np.lexsort((-own, at))  # the farthest of each label first
            for i in order[np.unique(at[order], return_index=True)[1]].tolist():
                label = int(at[i])
                if own[i] > far[label][0]:
                    far[label] = (float(own[i]), x[i])
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.float64())), pa.array([far[i][0] for i in seen], pa.float64()), pa.array([far[i][1] for i in seen], pa.list_(pa.float64()))],
            ["label", "n", "total", "far", "at"],
        )

    parts = rows.mapInArrow(run, "label int, n long, total array<double>, far double, at array<double>")
    sums = parts.groupBy("label").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)], F.max(F.struct("far", "at")).alias("far")).collect()
    total, count, far = np.zeros((k, dim)), np.zeros(k, np.int64), []
    for r in sums:
        count[r.label] = r.n
        total[r.label] = [r[f"t{i}"] for i in range(dim)]
        far.append((r.far["far"], r.label, np.array(r.far["at"])))
    return total, count, sorted(far, key=lambda f: (-f[0], f[1]))


def kmeans(docs: DataFrame, k: int, max_iterations: int = 100, penalty: float = 0.0, initial: Sequence[Sequence[float]] | None = None, vector_col: str = "vector", doc_id: str = "doc_id") -> np.ndarray:
    """The centroids, k of them or as many as there are vectors. It ends when nothing changes any more.

    It begins with the `initial` vectors, or else with the k of least hash. The penalty times a cluster's size in the iteration before
    is added to the squared distances.
    """
    rows = docs.select(F.col(vector_col).cast("array<double>").alias("vector"))
    if initial is None:
        initial = [r.vector for r in sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(vector_col).cast("array<double>").alias("vector")), k).collect()]
    centroids = np.array(initial, np.float64)
    sizes = np.zeros(len(centroids), np.int64)
    for _ in range(max_iterations):
        total, count, far = _step(rows, centroids, sizes, penalty)
        empty = np.flatnonzero(count == 0).tolist()
        for label, (_, giver, at) in zip(empty, [f for f in far if count[f[1]] > 1]):
            total[label], count[label] = at, 1
            total[giver] -= at
            count[giver] -= 1
        fresh = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        if np.array_equal(fresh, centroids) and (penalty == 0 or np.array_equal(count, sizes)):
            break
        centroids, sizes = fresh, count
    return centroids


def build_centroids(docs: DataFrame, centroids: int, max_list: int | None = None, training_rows: int = 20000, max_iterations: int = 100, penalty: float = 0.0) -> np.ndarray:
    """Centroids for an index of docs (doc_id, vector): trained on a sample, then lists longer than `max_list` are clustered
    again by themselves, and lists that stay empty are dropped."""
    n = docs.count()
    if n == 0:
        return np.zeros((0, 0))
    want = cluster_count(n, centroids, max_list)
    # every iteration reads the sample again: it is written once
    found = kmeans(stored(sample(docs.select("doc_id", "vector"), max(want, training_rows))), min(want, n), max_iterations, penalty)
    while True:
        sizes = _sizes(docs.select("vector"), found)
        keep = [found[i] for i in range(len(found)) if sizes.get(i, 0) and not (max_list and sizes[i] > max_list)]
        long = {label: size for label, size in sizes.items() if max_list and size > max_list}
        if not long:
            return np.array(keep)
        parts = _split(_tagged(docs.select("doc_id", "vector"), found, only=sorted(long)), long, max_list, training_rows, max_iterations, penalty)
        grown, split = list(keep), False
        for label in sorted(long):
            grown += parts[label]
            split |= len(parts[label]) > 1
        found = np.array(grown)
        if not split:  # nothing is too long, or only equal vectors are
            return found


def _split(tagged: DataFrame, sizes: dict[int, int], max_list: int, rows: int, max_iterations: int, penalty: float) -> dict[int, list[np.ndarray]]:
    """New centroids in place of each label's, from `rows` of its vectors; all labels at once, each in one task."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = tagged.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= rows).select("label", F.col("vector").cast("array<double>").alias("vector"), F.col("__r").alias("r"))

    def cluster(t: pa.Table) -> pa.Table:
        label = t["label"][0].as_py()
        x = matrix(t["vector"].combine_chunks())[np.argsort(t["r"].to_numpy())]
        found = lloyd(x, min(len(x), math.ceil(sizes[label] / max_list) + 1), max_iterations, penalty)
        return pa.table([pa.array([label] * len(found), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))], ["label", "centroid"])

    out: dict[int, list[np.ndarray]] = {label: [] for label in sizes}
    for r in chosen.groupBy("label").applyInArrow(cluster, "label int, centroid array<double>").collect():  # centroids alone
        out[r.label].append(np.array(r.centroid))
    return out


def lloyd(x: np.ndarray, k: int, max_iterations: int, penalty: float) -> np.ndarray:
    """K-means of vectors in memory, from the first k distinct ones."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]]
    sizes = np.zeros(len(c))
    for _ in range(max_iterations):
        at = costs(x, c, sizes, penalty).argmin(1)
        sizes = np.bincount(at, minlength=len(c)).astype(np.float64)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        fresh = np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], c)
        if np.array_equal(fresh, c):
            break
        c = fresh
    return c[sizes > 0]


def table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "centroid_id int, centroid array<double>")
