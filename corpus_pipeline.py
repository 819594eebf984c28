"""A corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

1. toxicity: documents that score as toxic go, by the lexicon with what the labels beside the documents teach.
2. line dedup: lines of more than 10 documents go, where a group of near copies counts as one document. A document
   that would lose all its lines stays. Near-dedup decides on copies.
3. MinHash near-dedup: of each group of near copies the document of lowest id stays, unless one of those of other groups holds it:
   then the larger stays. No two documents that stay meet the threshold, of whatever sizes. Documents
   without an id or without words are no copies.
4. mixing: documents in the order of the slots that the target weights give to their sources; what a source has
   beyond its weight stays out.
5. SentencePiece: the ids of every text, and whether they decode to it.

Every stage but the last returns the columns of its input, whatever their names. Toxicity judges each row by its text; the other stages take rows that
share an id for one document: all go or stay, but a line goes from each by itself. A null text counts as empty, but stays null; a document with null or
empty text is neither toxic nor a copy. Rows without an id are no copies; in mixing they are one document. A null source is the source ''.
Repeated rows stay repeated; ties go to the lowest id; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.names import col, cols, fresh
from lodestone.llm.op02_sentencepiece import encode
from lodestone.llm.op03_toxicity import THRESHOLD, lexicon_of, scores
from lodestone.llm.op04_line_dedup import line_dedup
from lodestone.llm.op09_mixing import mix
from lodestone.llm.op10_minhash import duplicates, near_copies
from lodestone.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (found,) = fresh(docs, "found")
    return docs.withColumn(found, scores(docs, lexicon=lexicon_of(docs, sf_dir))).filter(F.col(found)["score"] < THRESHOLD).select(*cols(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    disk = Scratch(spark)
    copies = disk.keep(near_copies(docs), "copies")
    out = line_dedup(docs, keep_whole=True, counts=False, groups=copies)
    return out.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (gone,) = fresh(docs, "gone")
    copies = duplicates(docs, held="firsts").filter("doc_id <> group_id OR container_id IS NOT NULL").select(F.col("doc_id").alias(gone))
    return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slot, source, ident = fresh(docs, "slot", "mixed_source", "mixed_id")
    plan = mix(docs).select(F.col("slot").alias(slot), F.col("source").alias(source), F.col("doc_id").alias(ident))
    same = docs["doc_id"].eqNullSafe(F.col(ident)) & (F.coalesce(docs["source"], F.lit("")) == F.col(source))
    return docs.join(plan, same).repartitionByRange(slot).sortWithinPartitions(slot, "doc_id").select(*cols(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", tokenise)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = disk.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            disk.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
