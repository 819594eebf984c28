"""Clustered indexes: centroids, assignment of vectors to them, postings, and search that probes a few of them.

Tables: centroids (keys, centroid_id, centroid), postings (keys, centroid_id, doc_id, vector), where keys are
whatever an index is separate by, such as user_id and segment. A centroid's row number is the tie-break everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.distance import Metric, distance, l2_squared, mean_vector
from lodestone.operators.search import best, near_pairs


def cluster_count(n: int, centroids: int, max_list: int | None = None) -> int:
    """Of n vectors: enough lists that none need be longer than max_list, and at least `centroids`."""
    if n <= 0:
        return 0
    per_list = math.ceil(n / max(1, centroids))
    return math.ceil(n / min(per_list, max_list or per_list))


def assign(docs: DataFrame, centroids: DataFrame, keys: Sequence[str] = (), max_clusters: int = 1, threshold: float = 0.1) -> DataFrame:
    """docs with centroid_id and squared distance: the nearest centroids of each, as far as |d - dmin| <= dmin * threshold, `max_clusters` at most.

    Centroids are joined by their keys; without keys every vector meets every centroid, the smaller side, which Spark broadcasts if it is small.
    """
    near = centroids.select(*keys, "centroid_id", "centroid")
    pairs = docs.join(near, list(keys)) if keys else docs.crossJoin(near)
    ids = [*keys, "doc_id"]
    scored = pairs.withColumn("distance", l2_squared("vector", "centroid")).drop("centroid")
    order = Window.partitionBy(*ids).orderBy("distance", "centroid_id")
    scored = scored.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= max_clusters)
    if max_clusters == 1:
        return scored.drop("__rank")
    least = F.min("distance").over(Window.partitionBy(*ids))
    return scored.withColumn("__least", least).filter(F.col("distance") - F.col("__least") <= F.col("__least") * threshold).drop("__rank", "__least")


def cluster_sizes(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return assigned.groupBy(*keys, "centroid_id").agg(F.count("*").alias("size"))


def cluster_means(assigned: DataFrame, dim: int, keys: Sequence[str] = ()) -> DataFrame:
    return assigned.groupBy(*keys, "centroid_id").agg(mean_vector("vector", dim).alias("centroid"))


def probe(queries: DataFrame, centroids: DataFrame, probes: int, ratio: float | None = None, keys: Sequence[str] = (), metric: Metric = "l2") -> DataFrame:
    """query_id, keys, centroid_id, centroid_score: the nearest centroids of each query and index, and with a ratio
    only those of score s with s - smin <= smin * ratio."""
    pairs = queries.crossJoin(centroids.select(*keys, "centroid_id", "centroid"))
    scored = pairs.select("query_id", *keys, "centroid_id", F.col("vector").alias("query"), distance("vector", "centroid", metric).alias("centroid_score"))
    group = Window.partitionBy("query_id", *keys)
    near = scored.withColumn("__rank", F.row_number().over(group.orderBy("centroid_score", "centroid_id"))).filter(F.col("__rank") <= probes)
    if ratio is not None:
        near = near.withColumn("__least", F.min("centroid_score").over(group)).filter(F.col("centroid_score") - F.col("__least") <= F.col("__least") * ratio).drop("__least")
    return near.drop("__rank")


def search(queries: DataFrame, centroids: DataFrame, postings: DataFrame, k: int, probes: int, ratio: float | None = 0.1, keys: Sequence[str] = (), metric: Metric = "l2", matched: DataFrame | None = None, dedup: bool = True, many: bool = False, score: Column | None = None) -> DataFrame:
    """query_id, doc_id, score and rank: the k best of the postings of the probed centroids, over all keys.

    `matched` restricts the documents (keys, doc_id) before they are scored. With `dedup`, a document counts once for each of
    its keys, in however many lists it stands; without, each listing is a result. For `many` queries, each list meets
    blocks of the queries that probe it in matrix products, which leave its k best. `score` is another score of
    vector (of keys, vector and query) than the metric's; it isn't for `many` queries.
    """
    lists = postings.join(matched.select(*keys, "doc_id").distinct(), [*keys, "doc_id"], "left_semi") if matched is not None else postings
    near = probe(queries, centroids, probes, ratio, keys, metric).select("query_id", *keys, "centroid_id", "query")
    by = [*keys, "centroid_id"]
    if many:
        # no list has a query twice
        found = near_pairs(near.withColumnRenamed("query", "vector"), lists.select(*by, "doc_id", "vector"), k, metric, by, queries.count())
        scored = found.repartition("query_id").select("query_id", *keys, "doc_id", "score")
    else:
        scored = lists.join(near, by).select("query_id", *keys, "doc_id", (distance("vector", "query", metric) if score is None else score).alias("score"))
    if dedup:
        scored = scored.groupBy("query_id", *keys, "doc_id").agg(F.min("score").alias("score"))
    return best(scored, k).select("query_id", *keys, "doc_id", "score", "rank")


def point_ids(docs: DataFrame, keys: Sequence[str] = ("user_id", "segment")) -> DataFrame:
    """Numbers the documents of each index from 0, in the order of their lists."""
    order = [c for c in ("centroid_id",) if c in docs.columns]
    return docs.withColumn("point_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "doc_id")) - 1)


def nearest(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """doc_id, centroid_id and L2 distance of the nearest centroid."""
    return assign(docs, centroids).select("doc_id", "centroid_id", F.sqrt("distance").alias("distance"))


