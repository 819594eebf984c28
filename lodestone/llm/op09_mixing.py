"""Mixing sources to target weights by a low-discrepancy schedule.

* Slot n has the point (n * 2654435769) mod 2**32, the golden-ratio sequence in 32 bits. The cumulative
  weights map it to a source, so any stretch of slots holds every source in proportion, off by a few slots.
* A source's slots are ranked. Its documents are shuffled (by md5 of seed and id) and cut into blocks of
  `block` tokens; the r-th slot of a source takes its r-th block. A document belongs to the block in which its
  first token lies, and is never split.
* With no number of slots given, the schedule ends where the first source would run out: every prefix has
  the target weights, nothing is repeated, and what a source has beyond its weight stays out. With `slots` given,
  a source that runs out begins again, and `epoch` counts how often.

Nothing is ordered in one task: tokens add up within 65,536 hash buckets of a source whose totals add up apart, and slots are
ranked within chunks of 2**20. What reaches the driver is one row for each source.

Weights given are taken as they are (sources without one stay out); else a source of t tokens has floor(t ** 0.75), so that large ones
don't drown small ones. Tokens are counted as white space (space, line feed) between words: one more than its characters.

Defined results: rows with the same id and source move as one document; a null id is an id of its own;
a null source is the source ''; null and empty texts have 0 tokens and lie in the block that is reached by then;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.names import col

GOLDEN, POINTS = 2654435769, 1 << 32
BLOCK, SEED, SLACK, CHUNK = 2048, "mix", 64, 20


def token_count(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(F.length(text) > 0, F.length(text) - F.length(bare) + 1).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, slots: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """slot, epoch, block, source, doc_id and n_tokens: where in the mixture each document stands."""
    spark = docs.sparkSession
    source = F.coalesce(col(source_col).cast("string"), F.lit(""))
    base = docs.select(col(id_col).alias("doc_id"), source.alias("source"), token_count(col(text_col)).alias("n")).groupBy("source", "doc_id").agg(F.sum("n").alias("n_tokens"))
    base = base.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).cast("string"))
    base = base.withColumn("bucket", F.substring("key", 1, 4))
    sums = base.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("here"))
    if weights is not None:
        wanted = F.col("source").isin([s for s, w in weights.items() if w > 0])
        base, sums = base.filter(wanted), sums.filter(wanted)
    totals = {r.source: r.t for r in sums.groupBy("source").agg(F.sum("here").alias("t")).collect()}  # a row for each source
    plan = schedule(spark, totals, weights, block, slots)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, ["source", "bucket"])
    blocks = spark.createDataFrame([(s, max(1, -(-t // block))) for s, t in totals.items()], "source string, blocks long")
    placed = placed.join(blocks, "source").withColumn("block", F.least(F.floor((F.col("start") + F.col("within")) / block), F.col("blocks") - 1).cast("long"))
    return placed.join(plan, ["source", "block"]).select("slot", "epoch", "block", "source", "doc_id", "n_tokens")


def schedule(spark: SparkSession, totals: dict[str, int], weights: dict[str, int] | None, block: int, slots: int | None) -> DataFrame:
    """slot, epoch, block and source of every slot of the schedule; totals has the tokens of each source."""
    names = sorted(totals)
    if not names:
        return spark.createDataFrame([], "slot long, epoch long, block long, source string")
    sizes = [max(1, -(-totals[s] // block)) for s in names]
    if weights is None:
        # floor(t ** 0.75), written so that any engine rounds alike
        w = [max(1, int((totals[s] ** 0.5) * ((totals[s] ** 0.5) ** 0.5))) for s in names]
    else:
        w = [int(weights[s]) for s in names]
    whole, ends, acc = sum(w), [], 0
    for x in w:
        acc += x
        ends.append(acc)
    count = slots if slots is not None else min(-(-(n + SLACK) * whole // x) for n, x in zip(sizes, w))
    point = (F.col("slot") * GOLDEN) % POINTS
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e * F.lit(POINTS) <= point * F.lit(whole)))
    rows = spark.range(count).select(F.col("id").alias("slot"), F.shiftright("id", CHUNK).alias("chunk")).withColumn("s", at)
    counts = rows.groupBy("s", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("s", "chunk", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1 + F.col("offset")
    info = spark.createDataFrame(list(zip(range(len(names)), names, sizes)), "s int, source string, blocks long")
    rows = rows.join(offset, ["s", "chunk"]).withColumn("rank", rank).join(F.broadcast(info), "s")  # info: a row for each source
    if slots is None:
        end = rows.filter(F.col("rank") >= F.col("blocks")).agg(F.min("slot").alias("end"))
        rows = rows.crossJoin(F.broadcast(end)).filter(F.coalesce(F.col("slot") < F.col("end"), F.lit(True)))
    return rows.select("slot", F.floor(F.col("rank") / F.col("blocks")).cast("long").alias("epoch"), (F.col("rank") % F.col("blocks")).cast("long").alias("block"), "source")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents, to weights of tokens ** 0.75."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(block: int = BLOCK, seed: str = SEED) -> str:
    """The same with the weights of `mix` and no number of slots."""
    return f"""
WITH base AS (SELECT coalesce(source, '') AS source, doc_id, CAST(sum(CASE WHEN length(text) > 0 THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END) AS BIGINT) AS n_tokens FROM documents GROUP BY 1, 2),
keyed AS (SELECT *, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM base),
cum AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
tot AS (SELECT source, sum(n_tokens) AS t FROM base GROUP BY 1),
src AS (SELECT source, greatest(1, CAST(ceil(t / {block}.0) AS BIGINT)) AS blocks, greatest(1, CAST(floor(sqrt(t) * sqrt(sqrt(t))) AS BIGINT)) AS w FROM tot),
acc AS (SELECT *, sum(w) OVER (ORDER BY source) - w AS lo, sum(w) OVER (ORDER BY source) AS hi, sum(w) OVER () AS whole FROM src),
m AS (SELECT CAST(min(ceil((blocks + {SLACK}) * whole / w)) AS BIGINT) AS m FROM acc),
pts AS (SELECT n, (n * {GOLDEN}) % {POINTS} AS u FROM (SELECT unnest(range(m)) AS n FROM m)),
ranked AS (SELECT p.n AS slot, a.source, a.blocks, row_number() OVER (PARTITION BY a.source ORDER BY p.n) - 1 AS rank FROM pts p JOIN acc a ON a.lo * {POINTS} <= p.u * a.whole AND p.u * a.whole < a.hi * {POINTS}),
fin AS (SELECT min(slot) AS fin FROM ranked WHERE rank >= blocks),
slots AS (SELECT slot, source, rank AS block FROM ranked, fin WHERE fin IS NULL OR slot < fin),
blk AS (SELECT c.*, least(CAST(floor(before / {block}) AS BIGINT), s.blocks - 1) AS block FROM cum c JOIN src s USING (source))
SELECT CAST(slots.slot AS BIGINT) AS slot, CAST(0 AS BIGINT) AS epoch, CAST(blk.block AS BIGINT) AS block, blk.source, blk.doc_id, blk.n_tokens FROM blk JOIN slots ON blk.source = slots.source AND blk.block = slots.block"""


QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {"op9_mixing": sql()}
