"""Distances of vectors as column expressions, in double precision; smaller is closer.

Sums run from the first dimension to the last, so that a result doesn't depend on batches. The dot
product's distance is its negative, and its square is itself. Vectors must have one length; `checked` says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import ColumnLike, col

Metric = str
METRICS = ("l2", "l2_squared", "negdot")


def _sum(a: ColumnLike, b: ColumnLike, of) -> Column:
    terms = F.zip_with(col(a), col(b), lambda x, y: of(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def l2_squared(a: ColumnLike, b: ColumnLike) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(l2_squared(a, b))


def negdot(a: ColumnLike, b: ColumnLike) -> Column:
    return -_sum(a, b, lambda x, y: x * y)


def distance(a: ColumnLike, b: ColumnLike, metric: Metric = "l2") -> Column:
    if metric not in METRICS:
        raise ValueError(f"{metric}: no such distance; there are {', '.join(METRICS)}")
    return {"l2": l2, "l2_squared": l2_squared, "negdot": negdot}[metric](a, b)


def checked(vector: ColumnLike, dim: int) -> Column:
    """The vector, or an error at run time if it hasn't `dim` elements."""
    v = col(vector)
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dim} is needed, not of "), F.size(v).cast("string"))))


def mean_vector(vector: ColumnLike, dim: int) -> Column:
    """The aggregate of element-wise means."""
    v = col(vector)
    return F.array(*[F.avg(v[i].cast("double")) for i in range(dim)])
