"""Queries of term search and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.codecs import decode_list, encode_list
from lodestone.functions.text import lower_tokens
from lodestone.operators import search
from lodestone.operators.filters import And, Contains, DocIds, Filter, Ids, NotContains, Or, Schema, condition, matches, restrict, used_terms
from lodestone.operators.terms import postings, term_statistics, terms_of
from lodestone.plans.tables import QUERY_SQL, l2_squared_sql, query_vector, read

SCHEMA = Schema(frozenset(("source",)), {"text": "none"})
TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda t: t <> ''))"
D = f"d AS (SELECT doc_id, source, {TOKENS} AS t FROM documents)"


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return terms_of(terms_of(docs, "text"), "source", None).drop("text")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(indexed(spark, sf_dir), ["text", "source"])


def tokenize_ws_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", lower_tokens("text").alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"), F.get("t", F.size("t") - 1).alias("last_token"))


def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_statistics(index(spark, sf_dir))


def postings_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's list of documents, coded and decoded."""
    lists = index(spark, sf_dir).groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    back = lists.select("term", decode_list(encode_list("ids")).alias("ids"))
    return back.select("term", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first_doc"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


#: Each filter, and the same in SQL over d(doc_id, source, t).
FILTERS: dict[str, tuple[Filter, str]] = {
    "term_contains_all": (Contains("text", "The OF and"), "list_contains(t, 'the') AND list_contains(t, 'of') AND list_contains(t, 'and')"),
    "term_unknown": (Contains("text", "the nosuchword"), "false"),
    "term_and": (And((Contains("text", "thing"), Contains("source", "src3"))), "list_contains(t, 'thing') AND source = 'src3'"),
    "term_or": (Or((Contains("text", "is"), Contains("text", "der"))), "list_contains(t, 'is') OR list_contains(t, 'der')"),
    "term_not": (NotContains("text", "the"), "NOT list_contains(t, 'the')"),
    "term_empty_and": (And(()), "false"),
    "term_nested": (
        Or((And((Contains("text", "der"), NotContains("text", "die"))), And((Or((Contains("text", "la"), Contains("text", "el"))), Contains("source", "src7"))))),
        "(list_contains(t, 'der') AND NOT list_contains(t, 'die')) OR ((list_contains(t, 'la') OR list_contains(t, 'el')) AND source = 'src7')",
    ),
    "keyword_filter": (Contains("source", "src11"), "source = 'src11'"),
}


def _by_index(f: Filter):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        everything = read(spark, sf_dir, "documents").select("doc_id")
        wanted = postings(indexed(spark, sf_dir), ["text", "source"], only=used_terms(f, SCHEMA))
        return matches(f, wanted, everything, SCHEMA).distinct()

    return run


def term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter evaluated in the scan of the documents, without an index."""
    return indexed(spark, sf_dir).filter(condition(FILTERS["term_nested"][0], SCHEMA)).select("doc_id").distinct()


def term_search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_search(_by_index(FILTERS["term_or"][0])(spark, sf_dir), 25)


def ids_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers within each user, from 0, as a filter; and documents' ids."""
    from lodestone.operators.ann import point_ids
    from lodestone.plans.tables import vectors

    v = point_ids(vectors(spark, sf_dir).select("user_id", "doc_id"), ["user_id"])
    return v.filter(condition(Or((Ids((0, 2, 4)), DocIds((17, 18)))))).select("user_id", "doc_id", F.col("point_id").cast("long").alias("point_id"))


def candidates_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter within candidates, beside the same without any, which is no restriction."""
    matched = _by_index(FILTERS["term_contains_all"][0])(spark, sf_dir)
    some = restrict([1, 2, 3, 5, 8, 13], matched).select("doc_id", F.lit("some").alias("candidates"))
    return some.union(restrict([], matched).select("doc_id", F.lit("none")))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return v.join(_by_index(FILTERS["term_or"][0])(spark, sf_dir), "doc_id", "left_semi")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter first, and the distances of what it leaves."""
    return search.top_k(_hybrid(spark, sf_dir), query_vector(spark, sf_dir), 10).select("doc_id", "score")


def stem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed terms of all documents, in each one's language, that match stemmed German words."""
    docs = terms_of(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", F.col("lang"))
    f = Contains("text", "einheiten der")
    return docs.filter(condition(f, Schema(languages={"text": "german"}))).select("doc_id", "lang", F.size("terms_text").alias("n_terms"))


QUERIES = {n: _by_index(f) for n, (f, _) in FILTERS.items()} | {f.__name__: f for f in (tokenize_ws_lower, term_index, postings_codec, term_scan, term_search_limit, ids_filter, candidates_restrict, hybrid_topk, stem_search)}
_OR = FILTERS["term_or"][1]
_ALL = FILTERS["term_contains_all"][1]
_I = f"{D}, i AS (SELECT DISTINCT doc_id, 'text:' || unnest(t) AS term FROM d UNION SELECT doc_id, 'source:' || source FROM d WHERE source IS NOT NULL)"
ORACLE = {n: f"WITH {D} SELECT DISTINCT doc_id FROM d WHERE {sql}" for n, (_, sql) in FILTERS.items()} | {
    "tokenize_ws_lower": r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1] AS first_token, t[-1] AS last_token FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS t FROM documents)",
    "term_index": f"WITH {_I} SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM i GROUP BY term",
    "postings_codec": f"WITH {_I} SELECT term, CAST(count(*) AS INTEGER) AS n, min(doc_id) AS first_doc, CAST(sum(doc_id) AS BIGINT) AS total FROM i GROUP BY term",
    "term_scan": f"WITH {D} SELECT DISTINCT doc_id FROM d WHERE {FILTERS['term_nested'][1]}",
    "term_search_limit": f"WITH {D} SELECT DISTINCT doc_id FROM d WHERE {_OR} ORDER BY doc_id LIMIT 25",
    "ids_filter": "SELECT user_id, doc_id, point_id FROM (SELECT CAST(label AS BIGINT) AS user_id, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS point_id FROM embeddings) WHERE point_id IN (0, 2, 4) OR doc_id IN (17, 18)",
    "candidates_restrict": f"WITH {D}, m AS (SELECT DISTINCT doc_id FROM d WHERE {_ALL}) SELECT doc_id, 'some' AS candidates FROM m WHERE doc_id IN (1, 2, 3, 5, 8, 13) UNION ALL SELECT doc_id, 'none' FROM m",
    "hybrid_topk": f"WITH {D}, q AS (SELECT {QUERY_SQL} AS v) SELECT e.vec_id AS doc_id, sqrt({l2_squared_sql('e.embedding', 'q.v')}) AS score FROM embeddings e, q WHERE e.vec_id IN (SELECT doc_id FROM d WHERE {_OR}) ORDER BY score, doc_id LIMIT 10",
}
