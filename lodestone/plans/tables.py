from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, user_id and vector of the embeddings; the label stands for the user."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("user_id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """What the single-vector queries look for: the embedding of lowest id."""
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


QUERY_SQL = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def l2_squared_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))"


def negdot_sql(a: str, b: str) -> str:
    return f"-list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
