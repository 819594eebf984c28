"""Queries of exact nearest-neighbour search, identifiers and packed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.packed import pack_floats, split_vectors, unpack_floats
from lodestone.operators import search
from lodestone.plans.tables import QUERY_SQL, l2_squared_sql, negdot_sql, query_vector, read, vectors

K, RADIUS = 10, 1.3
SCORE = {"l2": f"sqrt({l2_squared_sql('e.embedding', 'q.v')})", "l2_squared": l2_squared_sql("e.embedding", "q.v"), "negdot": negdot_sql("e.embedding", "q.v")}
Q = f"q AS (SELECT {QUERY_SQL} AS v)"


def _topk(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.top_k(vectors(spark, sf_dir), query_vector(spark, sf_dir), K, metric).select("doc_id", "score")

    return run, f"WITH {Q} SELECT e.vec_id AS doc_id, {SCORE[metric]} AS score FROM embeddings e, q ORDER BY score, doc_id LIMIT {K}"


def _batch(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return search.top_k_batch(v, v.select(F.col("doc_id").alias("query_id"), "vector"), K, metric)

    return run, f"""
WITH s AS (SELECT a.vec_id AS query_id, e.vec_id AS doc_id, {SCORE[metric].replace("q.v", "a.embedding")} AS score FROM embeddings a, embeddings e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= {K}"""


def l2_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.within(vectors(spark, sf_dir), query_vector(spark, sf_dir), RADIUS).select("doc_id", "score")


def multiuser_topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k_users(vectors(spark, sf_dir), query_vector(spark, sf_dir), K, [1, 3, 5])


def per_user_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k_each_user(vectors(spark, sf_dir), query_vector(spark, sf_dir), K)


def user_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's documents are found by a filter that reaches the scan."""
    v = vectors(spark, sf_dir)
    return search.top_k(v, query_vector(spark, sf_dir), K, where=F.col("user_id") == 4).select("doc_id", "user_id", "score")


def shard_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards of all documents, each searched by itself, and the best of their results."""
    v, q = vectors(spark, sf_dir), query_vector(spark, sf_dir)
    return search.gather([search.top_k(v.filter(F.col("doc_id") % 4 == s), q, K) for s in range(4)], K)


def vector_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents of a result, by an equi-join on their ids."""
    hits = multiuser_topk_global(spark, sf_dir)
    return hits.join(vectors(spark, sf_dir), "doc_id").select("doc_id", "score", F.size("vector").alias("dim"), F.col("vector")[0].cast("double").alias("first"))


def result_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by score in ascending order, ties by id, NaN last: their values, NaN where the event is an error (given as -1)."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.round("value", 1)).alias("score"))
    ordered = e.orderBy("score", "doc_id")
    return ordered.select("doc_id", F.coalesce(F.nanvl("score", F.lit(None)), F.lit(-1.0)).alias("score"))


def id_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit identifiers of all customers from their keys, in every form and back."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("low"), (-F.col("c_nationkey")).cast("long").alias("high"))
    c = c.withColumn("id", ids.from_halves("low", "high"))
    c = c.withColumn("uuid", ids.to_uuid("id"))
    back = ids.from_bytes(ids.to_bytes("id"))
    return c.select("low", "high", "id", "uuid", (ids.from_uuid(F.upper("uuid")) == F.col("id")).alias("uuid_ok"), (back == F.col("id")).alias("bytes_ok"), ids.low_half("id").alias("low_back"), ids.high_half("id").alias("high_back"))


def packed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that travel as one binary for each user, unpacked and cut into rows again."""
    v = vectors(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "vector"))).alias("rows"))
    packed = v.select("user_id", F.transform("rows", lambda r: r.doc_id).alias("ids"), pack_floats(F.flatten(F.transform("rows", lambda r: r.vector))).alias("raw"))
    flat = packed.withColumn("flat", unpack_floats("raw"))
    cut = flat.withColumn("vectors", split_vectors("flat", 64)).select("user_id", F.explode(F.arrays_zip("ids", "vectors")).alias("x"))
    return cut.select("user_id", F.col("x.ids").alias("doc_id"), F.aggregate(F.col("x.vectors"), F.lit(0.0), lambda s, e: s + e.cast("double")).alias("total"))


_found = {f"{m}_topk": _topk(m) for m in ("l2", "l2_squared", "negdot")} | {f"{m}_topk_batch": _batch(m) for m in ("l2", "negdot")}
QUERIES = {k: v[0] for k, v in _found.items()} | {f.__name__: f for f in (l2_within_radius, multiuser_topk_global, per_user_topk, user_filter, shard_gather, vector_fetch, result_ordering, id_codecs, packed_insert)}
_SCORED = f"s AS (SELECT e.vec_id AS doc_id, CAST(e.label AS BIGINT) AS user_id, {SCORE['l2']} AS score FROM embeddings e, q)"
_USERS = f"u AS (SELECT doc_id, min(score) AS score FROM s WHERE user_id IN (1, 3, 5) GROUP BY doc_id ORDER BY score, doc_id LIMIT {K})"
ORACLE = {k: v[1] for k, v in _found.items()} | {
    "l2_within_radius": f"WITH {Q}, {_SCORED} SELECT doc_id, score FROM s WHERE score <= {RADIUS}",
    "multiuser_topk_global": f"WITH {Q}, {_SCORED}, {_USERS} SELECT doc_id, score FROM u",
    "per_user_topk": f"WITH {Q}, {_SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score, doc_id) AS INTEGER) AS rank FROM s) SELECT user_id, doc_id, score, rank FROM r WHERE rank <= {K}",
    "user_filter": f"WITH {Q}, {_SCORED} SELECT doc_id, user_id, score FROM s WHERE user_id = 4 ORDER BY score, doc_id LIMIT {K}",
    "shard_gather": f"WITH {Q}, {_SCORED} SELECT doc_id, score FROM s ORDER BY score, doc_id LIMIT {K}",
    "vector_fetch": f"WITH {Q}, {_SCORED}, {_USERS} SELECT u.doc_id, u.score, CAST(len(e.embedding) AS INTEGER) AS dim, CAST(e.embedding[1] AS DOUBLE) AS first FROM u JOIN embeddings e ON e.vec_id = u.doc_id",
    "result_ordering": "SELECT doc_id, CASE WHEN bad THEN -1.0 ELSE score END AS score FROM (SELECT event_id AS doc_id, event_type = 'error' AS bad, round(value, 1) AS score FROM events ORDER BY event_type = 'error', CASE WHEN event_type = 'error' THEN 0 ELSE round(value, 1) END, event_id)",
    "id_codecs": """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS low, CAST(-c_nationkey AS BIGINT) AS high FROM customer),
h AS (SELECT *, printf('%016x', high) || printf('%016x', low) AS id FROM c)
SELECT low, high, id, substr(id, 1, 8) || '-' || substr(id, 9, 4) || '-' || substr(id, 13, 4) || '-' || substr(id, 17, 4) || '-' || substr(id, 21) AS uuid, true AS uuid_ok, true AS bytes_ok, low AS low_back, high AS high_back FROM h""",
    "packed_insert": "SELECT CAST(label AS BIGINT) AS user_id, vec_id AS doc_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings",
}
