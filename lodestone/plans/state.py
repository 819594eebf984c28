"""Queries of operation logs, segments and collections. Events are operations: an "error" deletes, the others insert."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import oplog
from lodestone.plans.tables import QUERY_SQL, l2_squared_sql, query_vector, read, vectors
from lodestone.sources.collection import Collection, CollectionConfig
from lodestone.sources.workspace import shared_folder
from lodestone.streaming.ingest import ingest, operations

SEGMENT, MOST, PENDING = 1000, 5, 940


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "value")


def oplog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.latest(ops(spark, sf_dir)).select("user_id", "doc_id", "seq", "value")


def oplog_live_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live(ops(spark, sf_dir)).select("user_id", "doc_id", "seq", "value")


def oplog_snapshot_at_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at half of all sequence numbers."""
    rows = ops(spark, sf_dir)
    half = rows.agg(F.floor(F.max("seq") / 2)).first()[0]
    return oplog.latest(rows, half).select("user_id", "doc_id", "seq", "value")


def tombstone_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir)
    return oplog.without(rows.filter("op = 'insert'"), rows.filter("op = 'delete'")).select("user_id", "doc_id", "seq")


def segment_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.segment_rows(ops(spark, sf_dir), SEGMENT).select("segment", "user_id", "doc_id", "seq", "value")


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.segment_stats(ops(spark, sf_dir), SEGMENT)


def vacuum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_stats(spark, sf_dir).filter("deleted_ratio > 0.1").select("segment", "docs", "live")


def auto_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.merge_candidates(segment_stats(spark, sf_dir), MOST).select("segment", "docs")


def merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that the smallest ones are merged into."""
    rows = ops(spark, sf_dir)
    return oplog.merge(rows, SEGMENT, oplog.merge_candidates(oplog.segment_stats(rows, SEGMENT), MOST)).select("user_id", "doc_id", "seq", "value")


def auto_flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flushes of a log that is flushed whenever enough operations wait."""
    flush = F.floor(F.col("seq") / PENDING).cast("long").alias("flush")
    return ops(spark, sf_dir).groupBy(flush).agg(F.count("*").alias("ops"), F.max("seq").alias("sequence"), F.count_if(F.col("op") == "delete").alias("deletes"))


def recovery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be replayed after the last whole flush."""
    rows = ops(spark, sf_dir)
    flushed = rows.agg(F.floor((F.max("seq") + 1) / PENDING) * PENDING - 1).first()[0]
    return rows.filter(F.col("seq") > flushed).groupBy("op").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = oplog.histogram(ops(spark, sf_dir), "value", 1.0)
    return h.select(F.coalesce("bound", F.lit(-1.0)).alias("bound"), "n")


def _collection(spark: SparkSession, config: CollectionConfig) -> Collection:
    return Collection.create(spark, f"{shared_folder(spark)}/collections/{uuid.uuid4().hex}", config)


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings go into a collection, one user's are deleted, and the rest is searched."""
    c = _collection(spark, CollectionConfig(num_features=64, max_iterations=3))
    v = vectors(spark, sf_dir)
    c.insert(v)
    c.flush()
    c.remove_rows(v.filter("user_id = 3"))
    c.flush()
    users = [r.user_id for r in v.select("user_id").distinct().collect()]
    return c.snapshot().search(query_vector(spark, sf_dir), 10, users)


def collection_merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two flushes, by source; their segments are merged, and terms are searched."""
    from lodestone.operators.filters import And, Contains

    c = _collection(spark, CollectionConfig(num_features=1, attributes={"text": "text:none", "source": "keyword"}, max_iterations=2))
    d = read(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("user_id"), "doc_id", F.array(F.col("n_chars").cast("float")).alias("vector"), F.create_map(F.lit("text"), "text", F.lit("source"), "source").alias("attributes"))
    first = F.col("attributes")["source"] < "src2"
    for part in (first, ~first):
        c.insert(d.filter(part))
        c.flush()
    c.merge([r.name for r in c.segments().collect()])
    return c.snapshot().term_search(And((Contains("text", "the of"), Contains("source", "src3"))), None, [0])


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of operations, a flush for each micro-batch, and the state they leave."""
    c = _collection(spark, CollectionConfig(num_features=1, dedup="latest", initial_num_centroids=2, max_iterations=2))
    raw = operations(spark, f"{sf_dir}/events.parquet", read(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " "))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    rows = raw.select(
        F.col("event_id").alias("order"), op.alias("op"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"), F.array(F.col("value").cast("float")).alias("vector"), F.lit(None).cast("map<string,string>").alias("attributes")
    )
    ingest(c, rows, f"{c.root}/checkpoint").awaitTermination()
    return c.snapshot().docs().select("user_id", "doc_id", F.col("vector")[0].cast("double").alias("value"))


QUERIES = {f.__name__: f for f in (oplog_latest, oplog_live_copies, oplog_snapshot_at_seq, tombstone_antijoin, segment_upserts, segment_stats, vacuum_candidates, auto_merge_candidates, merge_segments, auto_flush_batches, recovery_replay, latency_histogram, collection_search, collection_merged_terms, streaming_ingest)}

_O = "o AS (SELECT event_id AS seq, event_type = 'error' AS del, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, value FROM events)"


def _live(where: str = "true") -> str:
    return f"{_O}, w AS (SELECT * FROM o WHERE {where}), x AS (SELECT *, max(CASE WHEN del THEN seq END) OVER (PARTITION BY user_id, doc_id) AS gone FROM w), l AS (SELECT * FROM x WHERE NOT del AND (gone IS NULL OR gone < seq))"


_LAST = "SELECT user_id, doc_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY seq DESC) AS r FROM l) WHERE r = 1"
_SEG = f"{_O}, s AS (SELECT segment, user_id, doc_id, seq, value, del FROM (SELECT *, seq // {SEGMENT} AS segment, row_number() OVER (PARTITION BY seq // {SEGMENT}, user_id, doc_id ORDER BY seq DESC) AS r FROM o) WHERE r = 1 AND NOT del)"
_STAT = f"{_SEG}, g AS (SELECT user_id, doc_id, max(seq) AS gone FROM o WHERE del GROUP BY ALL), v AS (SELECT s.*, gone IS NULL OR gone < seq AS ok FROM s LEFT JOIN g USING (user_id, doc_id)), st AS (SELECT segment, count(*) AS docs, count(*) FILTER (WHERE ok) AS live FROM v GROUP BY segment)"
_CAND = f"{_STAT}, cand AS (SELECT segment, docs FROM (SELECT *, row_number() OVER (ORDER BY docs, segment) AS r, count(*) OVER () AS n FROM st) WHERE n > {MOST} AND r <= n - {MOST - 1})"
ORACLE = {
    "oplog_latest": f"WITH {_live()} {_LAST}",
    "oplog_live_copies": f"WITH {_live()} SELECT user_id, doc_id, seq, value FROM l",
    "oplog_snapshot_at_seq": f"WITH {_live('seq <= (SELECT max(seq) // 2 FROM o)')} {_LAST}",
    "tombstone_antijoin": f"WITH {_live()} SELECT user_id, doc_id, seq FROM l",
    "segment_upserts": f"WITH {_SEG} SELECT segment, user_id, doc_id, seq, value FROM s",
    "segment_stats": f"WITH {_STAT} SELECT segment, docs, live, 1 - live / docs AS deleted_ratio FROM st",
    "vacuum_candidates": f"WITH {_STAT} SELECT segment, docs, live FROM st WHERE 1 - live / docs > 0.1",
    "auto_merge_candidates": f"WITH {_CAND} SELECT segment, docs FROM cand",
    "merge_segments": f"WITH {_CAND} SELECT user_id, doc_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY seq DESC) AS r FROM v WHERE ok AND segment IN (SELECT segment FROM cand)) WHERE r = 1",
    "auto_flush_batches": f"WITH {_O} SELECT seq // {PENDING} AS flush, count(*) AS ops, max(seq) AS sequence, count(*) FILTER (WHERE del) AS deletes FROM o GROUP BY 1",
    "recovery_replay": f"WITH {_O} SELECT CASE WHEN del THEN 'delete' ELSE 'insert' END AS op, count(*) AS n, min(seq) AS first, max(seq) AS last FROM o WHERE seq > (SELECT (max(seq) + 1) // {PENDING} * {PENDING} - 1 FROM o) GROUP BY 1",
    "latency_histogram": f"WITH {_O}, b AS (SELECT CAST(pow(2, unnest(range(10))) AS DOUBLE) AS bound) SELECT bound, count(*) FILTER (WHERE value <= bound) AS n FROM b, o GROUP BY bound UNION ALL SELECT -1.0, count(value) FROM o",
    "collection_search": f"WITH q AS (SELECT {QUERY_SQL} AS v) SELECT e.vec_id AS doc_id, sqrt({l2_squared_sql('e.embedding', 'q.v')}) AS score FROM embeddings e, q WHERE label <> 3 ORDER BY score, doc_id LIMIT 10",
    "collection_merged_terms": r"SELECT doc_id FROM (SELECT doc_id, source, regexp_split_to_array(lower(coalesce(text, '')), '\s+') AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'of') AND source = 'src3'",
    "streaming_ingest": f"WITH {_live()} SELECT user_id, doc_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM ({_LAST})",
}
