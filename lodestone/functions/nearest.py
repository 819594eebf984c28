"""The nearest of many vectors in numpy, exactly: a matrix product in single precision leaves out what can't be among the best, and the rest is
scored in double precision, dimension by dimension, as `functions.distance` does. Memory is that of ROWS x COLUMNS products, whatever is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, COLUMNS, FIRST, AT_ONCE = 1024, 8192, 2048, 1 << 18
#: Twice the relative error of a term in single precision.
EPSILON = 1.2e-7


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrays of numbers as rows; an error unless they have one length."""
    sizes = pc.list_value_length(vectors)
    if sizes.null_count or len(sizes) and pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors of one length are needed")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1 if len(vectors) and sizes[0].as_py() else 0)


class _Part:
    """Some rows, and the best of what they met: row, place and score, in order."""

    def __init__(self, rows: int, k: int):
        self.k, self.limit = k, np.full(rows, np.inf)
        self.row, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        row, place, score = np.concatenate((self.row, row)), np.concatenate((self.place, place)), np.concatenate((self.score, score))
        order = np.lexsort((place, score, row))  # NaN last
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        good = rank < self.k
        self.row, self.place, self.score = row[good], place[order[good]], score[order[good]]
        last = rank[good] == self.k - 1
        self.limit[self.row[last]] = np.where(np.isnan(self.score[last]), np.inf, self.score[last])


class Nearest:
    """Of vectors that come in batches the k nearest to each row of x; of equal scores the earlier."""

    def __init__(self, x: np.ndarray, k: int, metric: str):
        self.k, self.metric, self.seen = k, metric, 0
        self.columns = np.ascontiguousarray(x.T)
        with np.errstate(all="ignore"):
            self.square = (x * x).sum(1) if metric != "negdot" else np.zeros(len(x))
            self.length = np.sqrt((x * x).sum(1))
            self.left = np.hstack([-x if metric == "negdot" else -2 * x, np.ones((len(x), 1))]).astype(np.float32)
        self.parts = [_Part(len(x[a : a + ROWS]), k) for a in range(0, len(x), ROWS)]

    def add(self, y: np.ndarray, extra: np.ndarray | None = None) -> None:
        """extra: what is added to the scores of each vector."""
        with np.errstate(all="ignore"):
            for a in range(0, len(y), COLUMNS):
                self._add(y[a : a + COLUMNS], None if extra is None else extra[a : a + COLUMNS])

    def _add(self, y: np.ndarray, extra: np.ndarray | None) -> None:
        columns, square = np.ascontiguousarray(y.T), (y * y).sum(1)
        own = square if self.metric != "negdot" else np.zeros(len(y))
        own = own if extra is None else own + extra
        right = np.vstack([columns, own[None]]).astype(np.float32)
        reach, most = np.sqrt(square.max()), np.abs(own).max()
        for s, part in enumerate(self.parts):
            rows = slice(s * ROWS, (s + 1) * ROWS)
            about = self.left[rows] @ right
            slack = EPSILON * (len(right) + 16) * (2 * self.length[rows] * reach + most)
            limit = (part.limit**2 if self.metric == "l2" else part.limit) - self.square[rows]
            if len(y) >= self.k and np.isinf(limit).any():
                first = about.min(1) if self.k == 1 else np.partition(about[:, : max(FIRST, self.k)], self.k - 1, axis=1)[:, self.k - 1]
                limit = np.fmin(limit, first + slack)
            out = about > (limit + slack + EPSILON * (np.abs(limit) + self.square[rows])).astype(np.float32)[:, None]
            at = np.flatnonzero(np.logical_not(out, out=out))  # NaN stays
            for a in range(0, len(at), AT_ONCE):
                i, j = np.divmod(at[a : a + AT_ONCE], len(y))
                score = self._score(i + rows.start, j, columns, extra)
                good = ~(score >= part.limit[i])
                if good.any():
                    part.add(i[good], j[good] + self.seen, score[good])
        self.seen += len(y)

    def _score(self, i: np.ndarray, j: np.ndarray, columns: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
        total = np.zeros(len(i))
        for a, b in zip(self.columns, columns):
            total += a[i] * b[j] if self.metric == "negdot" else (a[i] - b[j]) ** 2
        total = {"l2": np.sqrt, "negdot": np.negative}.get(self.metric, np.asarray)(total)
        return total if extra is None else total + extra[j]

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, places and scores, some rows at once."""
        for s, part in enumerate(self.parts):
            yield part.row + s * ROWS, part.place, part.score


def nearest_label(x: np.ndarray, y: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of the nearest y by squared distance and what is added to it, and that sum; the lower of equal ones."""
    near = Nearest(x, 1, "l2_squared")
    near.add(y, extra)
    found = list(near.found()) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
