r"""Line dedup: lines that stand in more than `threshold` documents go, wherever they are.

A line is what lies between "\n"; it is compared without case, with white space at its ends removed
and other runs of white space as one space. Lines are exploded to 64-bit hashes of that form, distinct documents are counted for each,
and what is over the threshold goes back to the documents it stands in, whose lines are put together again in order. Only hashes and ids
are shuffled for the counting; the texts move once, to meet their own documents' lists.

Blank lines are never counted or dropped. With `keep_whole`, a document that would lose every line stays as it is:
a copied document is no boilerplate, and near-dedup has to see it. With `groups`, near copies count once for a line
that they share, for the same reason: what a group of copies has in common is its text.

Defined results: ids count documents, so repeated rows of one id are one document, and all rows without an id
together are one; a null text stays null with 0 lines, an empty one has one blank line; each input row
gives one row; other columns, whatever their names, are carried along, but for one with the name of a count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.names import col, fresh

THRESHOLD = 10


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\n\x0B\f\r]+", " ")))


def _hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep_whole: bool = False, counts: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """docs with the lines over the threshold taken out of text; with `counts`, n_lines and n_dropped after its columns. groups has doc_id and group_id."""
    key, drop, pieces, kept_name = fresh(docs, "key", "drop", "lines", "kept")
    ident, body = col(id_col), col(text_col)
    lines = docs.select(F.struct(ident.alias("id")).alias("k"), F.explode(F.split(body, "\n")).alias("line"))
    blank = _hash(F.lit(""))
    hashes = lines.select("k", _hash(F.col("line")).alias("h")).filter(F.col("h") != blank).distinct()
    often = hashes.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > threshold).select("h")
    hits = hashes.join(often, "h")  # a hot line's rows are split by AQE, since the other side has one row for it
    if groups is not None:
        member = groups.select(F.struct(F.col("doc_id").alias("id")).alias("k"), F.struct(F.col("group_id").alias("id")).alias("g"))
        units = hits.join(member, "k", "left").groupBy("h", F.coalesce("g", "k").alias("unit")).agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("n"))
        hits = hits.join(units.filter(F.col("n") > threshold).select("h"), "h")
    lists = hits.groupBy(F.col("k").alias(key)).agg(F.collect_list("h").alias(drop))
    split = F.split(body, "\n")
    out = docs.withColumn(key, F.struct(ident.alias("id"))).join(lists, key, "left")
    out = out.withColumn(pieces, F.when(F.col(drop).isNotNull(), split))
    out = out.withColumn(kept_name, F.when(F.col(drop).isNotNull(), F.filter(pieces, lambda x: ~F.array_contains(drop, _hash(x)))))
    if keep_whole:
        out = out.withColumn(kept_name, F.when(F.exists(kept_name, lambda x: F.trim(x) != ""), F.col(kept_name)))
    n_lines = F.coalesce(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    text = F.coalesce(F.array_join(kept_name, "\n"), body)
    dropped = F.coalesce(F.size(pieces) - F.size(kept_name), F.lit(0)).cast("long")
    wanted = [text.alias(text_col) if c == text_col else col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return out.select(*wanted, *([n_lines.alias("n_lines"), dropped.alias("n_dropped")] if counts else []))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines over the threshold."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql(threshold: int = THRESHOLD) -> str:
    norm = r"lower(trim(regexp_replace(l.line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))"
    return f"""
WITH l AS (SELECT doc_id, pos, lines[pos] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, pos, line, {norm} AS norm FROM l),
hot AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) > {threshold}),
m AS (SELECT n.*, hot.norm IS NOT NULL AS gone FROM n LEFT JOIN hot USING (norm)),
t AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN t USING (doc_id)"""


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {"op4_line_dedup": sql()}
