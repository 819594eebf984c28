"""Queries of clustered indexes and quantisers. The centroids, where results are compared, are the means of the labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.quantise import ProductQuantiser, one_bit_codes
from lodestone.operators import ann, kmeans
from lodestone.plans.tables import l2_squared_sql, query_vector, vectors

DIM, SUB, PROBES, SPANN_PROBES, K = 64, 8, 3, 6, 10


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ann.cluster_means(vectors(spark, sf_dir).withColumn("centroid_id", F.col("user_id").cast("int")), DIM)
    return means.select("centroid_id", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


def nearest_centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(vectors(spark, sf_dir), centroids(spark, sf_dir))


def multi_assign_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.assign(vectors(spark, sf_dir), centroids(spark, sf_dir), (), 3, 0.1).select("doc_id", "centroid_id", "distance")


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.cluster_sizes(ann.assign(vectors(spark, sf_dir), centroids(spark, sf_dir)))


def cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(spark, sf_dir).select("centroid_id", F.posexplode("centroid").alias("dim", "mean"))


def cluster_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists each user's index gets, for at least 4 lists of 20 vectors at most."""
    sizes = vectors(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    rows = [(r.user_id, r.n, ann.cluster_count(r.n, 4, 20)) for r in sizes.collect()]  # a row for each user's index
    return spark.createDataFrame(rows, "user_id long, n long, lists long")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "vector")


def probe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.probe(_queries(spark, sf_dir), centroids(spark, sf_dir), 5, 0.05).select("query_id", "centroid_id", "centroid_score")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.assign(vectors(spark, sf_dir), centroids(spark, sf_dir), (), 2, 0.1).select("doc_id", "centroid_id", "vector")


def spann_topk_fixed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k best of the lists of each vector's nearest centroids, for every vector."""
    return ann.search(_queries(spark, sf_dir), centroids(spark, sf_dir), _lists(spark, sf_dir), K, SPANN_PROBES, 0.1, many=True)


def ivf_topk_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without dedup, by probes alone: each listing is a result of its own."""
    q = spark.createDataFrame([(0, [float(x) for x in query_vector(spark, sf_dir)])], "query_id long, vector array<double>")
    return ann.search(q, centroids(spark, sf_dir), _lists(spark, sf_dir), K, PROBES, None, dedup=False).select("doc_id", "score")


def per_user_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index for each user, whose lists are its four shards; k best over all users' indexes."""
    v = vectors(spark, sf_dir).withColumn("centroid_id", (F.col("doc_id") % 4).cast("int"))
    own = ann.cluster_means(v, DIM, ["user_id"]).select("user_id", "centroid_id", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))
    q = spark.createDataFrame([(0, [float(x) for x in query_vector(spark, sf_dir)])], "query_id long, vector array<double>")
    return ann.search(q, own, v, K, 2, None, ["user_id"]).select("user_id", "doc_id", "score")


def _codebook(spark: SparkSession, sf_dir: str) -> ProductQuantiser:
    rows = sorted(centroids(spark, sf_dir).collect())  # a row for each label
    c = np.array([r.centroid for r in rows])
    return ProductQuantiser(np.stack([c[:, s : s + SUB] for s in range(0, DIM, SUB)]))


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectors(spark, sf_dir).select("doc_id", _codebook(spark, sf_dir).quantise("vector").alias("code"))
    return coded.select("doc_id", F.posexplode("code").alias("sub", "code")).select("doc_id", "sub", F.col("code").cast("int").alias("code"))


def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq = _codebook(spark, sf_dir)
    back = vectors(spark, sf_dir).select("doc_id", pq.original(pq.quantise("vector")).alias("v"))
    return back.select("doc_id", F.col("v")[0].alias("first"), F.col("v")[DIM - 1].alias("last"))


def pq_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k nearest codes to the query's code: squared distances, both sides quantised."""
    pq = _codebook(spark, sf_dir)
    code = pq.encode_array(np.array([query_vector(spark, sf_dir)]))[0]
    query = F.array(*[F.lit(int(c)).cast("short") for c in code])
    scored = vectors(spark, sf_dir).select("doc_id", F.round(pq.distance(pq.quantise("vector"), query), 9).alias("score"))
    return scored.orderBy("score", "doc_id").limit(K)


def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many vectors as training takes, without replacement: how many, and whether any came twice."""
    return kmeans.sample(vectors(spark, sf_dir), 100).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_docs"))


def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.build_centroids(vectors(spark, sf_dir), 10, 100, max_iterations=10)
    assigned = kmeans.labels(vectors(spark, sf_dir), found)
    return assigned.groupBy("label").agg(F.count("*").alias("size"), F.round(F.avg("cost"), 6).alias("mean_cost"))


def rabitq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_codes(vectors(spark, sf_dir), DIM).select("doc_id", F.hex("code").alias("code"), "length", "dot")


def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean squared error of codes from a trained codebook."""
    v = vectors(spark, sf_dir)
    pq = ProductQuantiser.train(v, 16, 4, 1000, 5)
    back = v.select(F.col("vector").cast("array<double>").alias("v"), pq.original(pq.quantise("vector")).alias("b"))
    error = F.aggregate(F.zip_with("v", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    return back.agg(F.count("*").alias("n"), F.avg(error).alias("error"))


QUERIES = {f.__name__: f for f in (nearest_centroid_assign, multi_assign_threshold, cluster_sizes, cluster_means, cluster_count_rule, probe_ratio, spann_topk_fixed_centroids, ivf_topk_listings, per_user_index_search, pq_encode, pq_decode, pq_distance, training_sample, kmeans_train, rabitq_encode, pq_train)}

_C = "c AS (SELECT label AS centroid_id, list(round(m, 6) ORDER BY i) AS centroid FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_A = f"a AS (SELECT vec_id AS doc_id, embedding, CAST(centroid_id AS INTEGER) AS centroid_id, {l2_squared_sql('embedding', 'centroid')} AS distance FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, centroid_id) AS k, min(distance) OVER (PARTITION BY doc_id) AS least FROM a)"
_B = f"{_C}, {_A}"
_P = f"p AS (SELECT doc_id AS query_id, centroid_id, sqrt(distance) AS centroid_score, row_number() OVER (PARTITION BY doc_id ORDER BY sqrt(distance), centroid_id) AS k, sqrt(least) AS smin, embedding AS query FROM r)"
_L = "l AS (SELECT doc_id, centroid_id, embedding FROM r WHERE k <= 2 AND distance - least <= least * 0.1)"
_S = f"b AS (SELECT c.centroid_id AS code, s, list_slice(centroid, s * {SUB} + 1, s * {SUB} + {SUB}) AS part FROM c, (SELECT unnest(range({DIM // SUB})) AS s))"
_E = f"{_C}, {_S}, e AS (SELECT doc_id, sub, code, part FROM (SELECT vec_id AS doc_id, s AS sub, code, part, row_number() OVER (PARTITION BY vec_id, s ORDER BY {l2_squared_sql('list_slice(embedding, s * 8 + 1, s * 8 + 8)', 'part')}, code) AS k FROM embeddings, b) WHERE k = 1)"
_Q0 = "(SELECT min(vec_id) FROM embeddings)"
ORACLE = {
    "nearest_centroid_assign": f"WITH {_B} SELECT doc_id, centroid_id, sqrt(distance) AS distance FROM r WHERE k = 1",
    "multi_assign_threshold": f"WITH {_B} SELECT doc_id, centroid_id, distance FROM r WHERE k <= 3 AND distance - least <= least * 0.1",
    "cluster_sizes": f"WITH {_B} SELECT centroid_id, count(*) AS size FROM r WHERE k = 1 GROUP BY centroid_id",
    "cluster_means": f"WITH {_C} SELECT CAST(centroid_id AS INTEGER) AS centroid_id, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, unnest(centroid) AS mean FROM c",
    "cluster_count_rule": "SELECT CAST(label AS BIGINT) AS user_id, count(*) AS n, CAST(ceil(count(*) / least(ceil(count(*) / 4.0), 20)) AS BIGINT) AS lists FROM embeddings GROUP BY label",
    "probe_ratio": f"WITH {_B}, {_P} SELECT query_id, centroid_id, centroid_score FROM p WHERE k <= 5 AND centroid_score - smin <= smin * 0.05",
    "spann_topk_fixed_centroids": f"""WITH {_B}, {_P}, {_L},
f AS (SELECT query_id, l.doc_id, min(sqrt({l2_squared_sql('l.embedding', 'p.query')})) AS score FROM p JOIN l USING (centroid_id) WHERE p.k <= {SPANN_PROBES} AND centroid_score - smin <= smin * 0.1 GROUP BY query_id, l.doc_id),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS INTEGER) AS rank FROM f) SELECT query_id, doc_id, score, rank FROM g WHERE rank <= {K}""",
    "ivf_topk_listings": f"WITH {_B}, {_P}, {_L} SELECT l.doc_id, sqrt({l2_squared_sql('l.embedding', 'p.query')}) AS score FROM p JOIN l USING (centroid_id) WHERE query_id = {_Q0} AND p.k <= {PROBES} ORDER BY score, doc_id LIMIT {K}",
    "per_user_index_search": f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = {_Q0}),
m AS (SELECT label, shard, list(round(m, 6) ORDER BY i) AS centroid FROM (SELECT label, vec_id % 4 AS shard, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label, shard),
s AS (SELECT label, shard, row_number() OVER (PARTITION BY label ORDER BY {l2_squared_sql('centroid', 'q.v')}, shard) AS k FROM m, q)
SELECT CAST(e.label AS BIGINT) AS user_id, e.vec_id AS doc_id, sqrt({l2_squared_sql('e.embedding', 'q.v')}) AS score FROM embeddings e, q JOIN s ON s.k <= 2 AND s.label = e.label AND s.shard = e.vec_id % 4 ORDER BY score, doc_id LIMIT {K}""",
    "pq_encode": f"WITH {_E} SELECT doc_id, CAST(sub AS INTEGER) AS sub, CAST(code AS INTEGER) AS code FROM e",
    "pq_decode": f"WITH {_E} SELECT x.doc_id, x.part[1] AS first, y.part[{SUB}] AS last FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.sub = 0 AND y.sub = {DIM // SUB - 1}",
    "pq_distance": f"WITH {_E}, d AS (SELECT x.doc_id, x.sub, {l2_squared_sql('x.part', 'y.part')} AS part FROM e x JOIN e y ON y.doc_id = {_Q0} AND x.sub = y.sub) SELECT doc_id, round(sum(part), 9) AS score FROM d GROUP BY doc_id ORDER BY score, doc_id LIMIT {K}",
    "training_sample": "SELECT least(count(*), 100) AS n, least(count(*), 100) AS distinct_docs FROM embeddings",
}
