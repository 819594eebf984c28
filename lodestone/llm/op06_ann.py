"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector less the mean of all is a length times a direction. The direction is turned by one random
rotation and only the signs are kept, packed 8 to a byte, with three scalars: the length, the inner product of direction and code, and
the number of ones. A query is turned alike and rounded to 4 bits a dimension; its inner product with a code is four
counts of ones in an AND of packed words, and a few multiplications by the scalars. Divided by the code's own inner product
that is an unbiased estimate, with an error of at most EPSILON standard widths, known for each pair beforehand.

Each query takes the exact products of some of its best estimates; the k-th of those is a threshold, and every vector
whose estimate plus error bound reaches it is reranked exactly. Nothing else is computed from the vectors themselves.

Vectors are packed into blocks of `block` where they lie. The stated queries (all rows, or those that a condition on the id picks) are taken in
batches of about `batch`, a bounded number that is broadcast; a task goes through its blocks with the k best so far of each query, whose
k-th is a threshold for the next block, and only its k best a query are shuffled and merged. Each batch of queries is a pass over the packed table: work is
queries times rows, and no vector is left out but by its bound. Vectors without clusters, as in the test data, leave an index of cells nothing to skip.

Defined results: vectors that are null, not of the most frequent length (the lower one if equal), or hold null, NaN or infinity
are left out, as are rows without an id; of rows that share an id the least vector counts; a vector is no neighbour of its own id;
ties go to the lower id; fewer than k others give fewer rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import arrays as A
from lodestone.llm.scratch import Scratch

K, EPSILON, BITS, BLOCK, BATCH, QUERIES_AT_ONCE, EVERY = 10, 1.9, 4, 8192, 1 << 16, 32, 50


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    wide = np.zeros((len(bits), words * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of directions and codes."""
    o = x.astype(np.float64) - mean
    length = np.linalg.norm(o, axis=1)
    o = (o / np.where(length > 0, length, 1)[:, None]) @ turn
    own = np.abs(o).sum(1) / np.sqrt(o.shape[1])
    return _pack(o > 0), length, np.where(length > 0, own, 1)


class Side:
    """The queries of a block: turned, rounded to BITS bits, in bit planes."""

    def __init__(self, x: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        q = x.astype(np.float64) - mean
        self.length = np.linalg.norm(q, axis=1)
        q = (q / np.where(self.length > 0, self.length, 1)[:, None]) @ turn
        self.low = q.min(1)
        self.step = np.maximum((q.max(1) - self.low) / (2**BITS - 1), 1e-12)
        u = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = u.sum(1, dtype=np.int64)
        self.planes = [_pack((u >> b & 1).astype(bool)) for b in range(BITS)]
        self.shift = x.astype(np.float64) @ mean - mean @ mean  # <q, o> = <q - c, o - c> + <q, c> + <o, c> - <c, c>


def products(side: Side, part: slice, packed: np.ndarray, ones: np.ndarray, dim: int) -> np.ndarray:
    """Inner products of unit queries and unit codes, from the packed bits."""
    count = np.zeros((part.stop - part.start, len(packed)), np.uint16)
    for b, plane in enumerate(side.planes):
        for w in range(packed.shape[1]):
            count += np.bitwise_count(plane[part, w, None] & packed[None, :, w]).astype(np.uint16) << np.uint16(b)
    root = np.sqrt(dim)
    step, low, total = side.step[part, None], side.low[part, None], side.total[part, None]
    out = count * (2 * step / root).astype(np.float32)
    out += (2 * low / root).astype(np.float32) * ones[None, :].astype(np.float32)
    out -= (step * total / root + root * low).astype(np.float32)
    return out


def search(qx: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, packed: np.ndarray, length: np.ndarray, own: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, epsilon: float = EPSILON, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, neighbour number and exact product of the best k for each query. known: products that k others of each query reach."""
    dim = x.shape[1]
    side = Side(qx, mean, turn)
    ones = np.bitwise_count(packed).sum(1, dtype=np.int64)
    scale = (length / own).astype(np.float32)
    width = (length * np.sqrt(np.maximum(1 - own**2, 0)) / own * epsilon / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    about = (x.astype(np.float64) @ mean).astype(np.float32)
    groups = max(1, min(len(x), max(16 * k, len(x) // 32)))
    edges = np.linspace(0, len(x), groups + 1).astype(np.int64)[:-1]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(qx), QUERIES_AT_ONCE):
        part = slice(a, min(a + QUERIES_AT_ONCE, len(qx)))
        q, qlen = qx[part], side.length[part, None].astype(np.float32)
        guess = products(side, part, packed, ones, dim)
        guess *= scale[None, :] * qlen
        guess += about[None, :]
        guess += side.shift[part, None].astype(np.float32)
        same = qids[part, None] == ids[None, :]
        guess[same] = -np.inf
        # k good ones, the best estimates of k groups: their worst exact product can't be above the k-th best of all
        rows = np.arange(len(q))
        best = np.maximum.reduceat(guess, edges, axis=1)
        least = np.full(len(q), -np.inf, np.float32)
        if groups >= k:
            top = np.argpartition(-best, k - 1, axis=1)[:, :k]
            level = best[rows[:, None], top]
            r, c = np.nonzero(guess >= np.where(np.isfinite(level), level, np.inf).min(1)[:, None])
            first = np.einsum("ij,ij->i", q[r], x[c])
            for i in np.unique(r).tolist():
                f = first[r == i]
                if len(f) >= k:
                    least[i] = np.partition(f, len(f) - k)[len(f) - k]
        if known is not None:
            least = np.maximum(least, known[part].astype(np.float32))
        slack = np.float32(1e-5) * (np.abs(least) + 1)
        floor = np.where(np.isfinite(least), least - slack, -np.inf)[:, None]
        guess += width[None, :] * qlen
        r, c = np.nonzero(guess >= floor)
        # the rerank, in single precision and then, for what still reaches the threshold, in double
        near = np.einsum("ij,ij->i", q[r], x[c]) >= floor[r, 0]
        r, c = r[near], c[near]
        alive = ~same[r, c]
        r, c = r[alive], c[alive]
        found = np.einsum("ij,ij->i", q[r].astype(np.float64), x[c].astype(np.float64))
        order = np.lexsort((ids[c], -found, r))
        r, c, found = r[order], c[order], found[order]
        good = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[good] + a, c[good], found[good]))
    return tuple(np.concatenate(z) for z in zip(*out))


class Best:
    """The k best of every query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate((self.q, q)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        order = np.lexsort((ids, -score, q))
        good = np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k
        order = order[good]
        self.q, self.id, self.score = q[order], ids[order], score[order]

    def known(self) -> np.ndarray:
        """The k-th product of each query; below every number where there are fewer."""
        out = np.full(self.n, -np.inf)
        last = np.flatnonzero(np.append(self.q[1:] != self.q[:-1], True)) if len(self.q) else np.zeros(0, np.int64)
        full = last[np.diff(np.append(-1, last)) == self.k]
        out[self.q[full]] = self.score[full]
        return out


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, epsilon: float = EPSILON, queries: Column | None = None, batch: int = BATCH) -> DataFrame:
    """vec_id, neighbour_id, score (the exact inner product) and rank from 1 to k. queries: a condition on vec_id; without it every row is a query."""
    spark, schema = vectors.sparkSession, "vec_id long, neighbour_id long, score double, rank int"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].d
    rows = rows.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    disk = Scratch(spark)
    rows = disk.keep(rows, "vectors")
    asked = rows if queries is None else rows.filter(queries)
    mean = np.array(rows.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).first(), np.float64)
    turn = rotation(dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)

        def packed(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, x, *codes(x, mean, turn))], ["ids", "x", "packed", "length", "own"])

        for b in batches:
            ids = np.concatenate((ids, b.column(0).to_numpy(zero_copy_only=False)))
            x = np.concatenate((x, b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)))
            while len(ids) >= block:
                yield packed(ids[:block], x[:block])
                ids, x = ids[block:], x[block:]
        if len(ids):
            yield packed(ids, x)

    blocks = disk.keep(rows.mapInArrow(pack, "ids binary, x binary, packed binary, length binary, own binary"), "blocks")
    passes = max(1, -(-asked.count() // batch))
    found = []
    for i in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow()  # about `batch` rows
        qids = own["vec_id"].to_numpy()
        qx = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
        sent = spark.sparkContext.broadcast((qids, qx))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, qx = sent.value
            best = Best(len(qids), k)
            for b in batches:
                for j in range(b.num_rows):
                    raw = [c[j].as_py() for c in b.columns]
                    ids, x = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.float32).reshape(-1, dim)
                    bits = np.frombuffer(raw[2], np.uint64).reshape(len(ids), -1)
                    q, c, s = search(qx, qids, x, ids, bits, np.frombuffer(raw[3], np.float64), np.frombuffer(raw[4], np.float64), mean, turn, k, epsilon, best.known())
                    best.add(q, ids[c], s)
            yield pa.RecordBatch.from_arrays([pa.array(qids[best.q]), pa.array(best.id), pa.array(best.score)], ["vec_id", "neighbour_id", "score"])

        if len(qids):
            part = blocks.mapInArrow(scan, "vec_id long, neighbour_id long, score double")
            found.append(part if passes == 1 else disk.keep(part, f"found-{i}"))
    if not found:
        return spark.createDataFrame([], schema)
    best = found[0] if passes == 1 else spark.read.schema(found[0].schema).parquet(f"{disk.root}/found-*")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours, among all rows, of every embedding whose id is divisible by EVERY."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % EVERY == 0)


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
ORACLE: dict[str, str] = {}
