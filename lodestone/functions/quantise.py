"""Quantisers: none, product quantisation and one-bit codes (RaBitQ).

A codebook has, for each subspace, the centroids of its codes, of at most 8 bits. The first of equal minima wins.
The distance of two product codes is the sum of squares, without a root; that of unquantised vectors is L2. Sums cover
every dimension of a subspace, whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import ColumnLike, col
from lodestone.functions.distance import mean_vector


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class NoQuantiser:
    def quantise(self, vector: ColumnLike) -> Column:
        return col(vector)

    def original(self, code: ColumnLike) -> Column:
        return col(code)


class ProductQuantiser:
    """codebook: subspaces x codes x dimensions of a subspace."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = np.asarray(codebook, np.float64)
        if self.codebook.ndim != 3 or self.codebook.shape[1] > 256:
            raise ValueError("a codebook is subspaces x codes (256 at most) x dimensions")

    @staticmethod
    def train(docs: DataFrame, subvector: int, bits: int = 8, rows: int = 10000, max_iterations: int = 25, vector_col: str = "vector") -> ProductQuantiser:
        """K-means of each subspace on `rows` live documents: one pass over them, a task for each subspace."""
        from lodestone.operators.kmeans import lloyd, sample

        dim = len(docs.select(vector_col).first()[0])
        if dim % subvector:
            raise ValueError(f"{dim} dimensions can't be cut into subvectors of {subvector}")
        parts = F.transform(F.sequence(F.lit(0), F.lit(dim // subvector - 1)), lambda s: F.slice("v", s * subvector + 1, F.lit(subvector)))
        chosen = sample(docs.select("doc_id", F.col(vector_col).cast("array<double>").alias("v")), rows).select("doc_id", F.posexplode(parts).alias("s", "part"))

        def train(t: pa.Table) -> pa.Table:
            order = np.argsort(t["doc_id"].to_numpy(), kind="stable")  # the same start however the rows come
            x = t["part"].combine_chunks().flatten().to_numpy().reshape(-1, subvector)[order]
            c = lloyd(x, 1 << bits, max_iterations, 0.0)
            return pa.table({"s": pa.array([t["s"][0].as_py()] * len(c), pa.int32()), "code": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(list(c), pa.list_(pa.float64()))})

        books: list[list[list[float]]] = [[] for _ in range(dim // subvector)]
        for r in sorted(chosen.groupBy("s").applyInArrow(train, "s int, code int, centroid array<double>").collect()):  # codes alone
            books[r.s].append(r.centroid)
        return ProductQuantiser(np.array([b + b[:1] * ((1 << bits) - len(b)) for b in books]))

    def encode_array(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.codebook.shape
        out = np.empty((len(x), m), np.int16)
        for s in range(m):
            cost = np.zeros((len(x), self.codebook.shape[1]))
            for j in range(d):
                cost += (x[:, s * d + j, None] - self.codebook[None, s, :, j]) ** 2
            out[:, s] = cost.argmin(1)
        return out

    def quantise(self, vector: ColumnLike) -> Column:
        @F.pandas_udf("array<smallint>")
        def encode(s: pd.Series) -> pd.Series:
            return pd.Series(list(self.encode_array(_stack(s)))) if len(s) else s

        return encode(col(vector))

    def original(self, code: ColumnLike) -> Column:
        @F.pandas_udf("array<double>")
        def decode(s: pd.Series) -> pd.Series:
            if not len(s):
                return s
            c = np.stack(s.to_numpy()).astype(np.int64)
            return pd.Series(list(np.concatenate([self.codebook[i, c[:, i]] for i in range(c.shape[1])], axis=1)))

        return decode(col(code))

    def distance(self, a: ColumnLike, b: ColumnLike) -> Column:
        """The squared L2 distance of the two codes' centroids, from a table of all pairs."""
        m, n, d = self.codebook.shape
        pairs = np.zeros((m, n, n))
        for j in range(d):
            pairs += (self.codebook[:, :, None, j] - self.codebook[:, None, :, j]) ** 2

        @F.pandas_udf("double")
        def between(a: pd.Series, b: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype=float)
            x, y = (np.stack(s.to_numpy()).astype(np.int64) for s in (a, b))
            out = np.zeros(len(x))
            for s in range(m):
                out += pairs[s, x[:, s], y[:, s]]
            return pd.Series(out)

        return between(col(a), col(b))


def one_bit_codes(docs: DataFrame, dim: int, seed: int = 0, vector_col: str = "vector") -> DataFrame:
    """docs with code (signs of the rotated direction from the mean, packed), length, and dot (of direction and code)."""
    mean = np.array(docs.agg(mean_vector(vector_col, dim).alias("m")).first().m or [0.0] * dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    turn = q * np.sign(np.diag(r))

    @F.pandas_udf("struct<code: binary, length: double, dot: double>")
    def encode(s: pd.Series) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({"code": [], "length": [], "dot": []})
        o = _stack(s) - mean
        length = np.linalg.norm(o, axis=1)
        o = (o / np.where(length > 0, length, 1)[:, None]) @ turn
        return pd.DataFrame({"code": [b.tobytes() for b in np.packbits(o > 0, axis=1)], "length": length, "dot": np.abs(o).sum(1) / np.sqrt(dim)})

    return docs.withColumn("__code", encode(F.col(vector_col))).select(*docs.columns, "__code.code", "__code.length", "__code.dot")
