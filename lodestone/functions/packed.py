"""Packed forms of vectors: little-endian 32-bit floats, one vector after another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import ColumnLike, col


def unpack_floats(raw: ColumnLike) -> Column:
    """The floats in a binary; an error if its length is no multiple of 4."""

    @F.pandas_udf("array<float>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpack(col(raw))


def pack_floats(vector: ColumnLike) -> Column:
    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(col(vector))


def split_vectors(flat: ColumnLike, dim: int) -> Column:
    """An array of vectors from one flat array; an error unless its length is a multiple of `dim`."""
    v = col(flat)
    whole = F.when(F.size(v) % dim == 0, v).otherwise(F.raise_error(F.lit(f"the number of values is no multiple of {dim}")))
    count = F.floor(F.size(whole) / dim).cast("int")
    return F.when(count == 0, F.array().cast("array<array<float>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(whole, i * dim + 1, F.lit(dim))))
