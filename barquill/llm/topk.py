"""Exact top-k search by integer inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquill.llm.vectors import Found, best, data_blocks, search, usable

CELL_BITS = 6
#: Integers and their sums are exact in doubles below this; components above FAR have no cell.
EXACT, FAR = float(1 << 53), 1e120
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _integers(row: np.ndarray) -> list[int]:
    """floor(1024 * x) of each component, whatever its size."""
    return [int(np.floor(1024.0 * x)) if abs(x) < 1e15 else 1024 * int(x) for x in row.tolist()]


class Cells:
    """Rows of a block as cells of at most 6 bits a component, kept as bytes, and the exact vectors behind them.

    A component's cell is its distance from the block's smallest value in equal steps. The cell's middle gives an
    estimate of an inner product that is off by no more than the query's components times half a step (and what single
    precision may lose), so every row has an upper bound. A row with a component too large for that, or beside one in its
    block, has no bound but infinity: it is always read. So is every row for a query of that kind.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix, self.width = ids, matrix, matrix.shape[1]
        with np.errstate(over="ignore"):
            whole = np.floor(1024.0 * matrix)
        self.size = np.abs(whole).max(axis=1)
        self.far = self.size >= FAR
        self.whole = np.where(self.far[:, None], 0.0, whole)
        self.low = self.whole.min(axis=0)
        self.step = np.maximum((self.whole.max(axis=0) - self.low) / ((1 << CELL_BITS) - 1), 1.0)
        self.cells = np.minimum((self.whole - self.low) // self.step, (1 << CELL_BITS) - 1).astype(np.uint8)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """An upper bound of each row's inner product with each query (of integers, none far)."""
        weight = query * self.step
        top = np.maximum(np.abs(weight).max(axis=1, initial=0.0), 1e-300)[:, None]
        near = (weight / top).astype(np.float32) @ self.cells.T.astype(np.float32)
        total = np.abs(weight).sum(axis=1)
        lost = (self.width + 8) * (1 << CELL_BITS) * 2.0**-22 * total + (self.width + 8) * 2.0**-50 * (np.abs(query) @ np.abs(self.low))
        upper = near * top + (query @ self.low + total + lost)[:, None]
        upper[:, self.far] = np.inf
        return upper

    def scores(self, query: np.ndarray, whole: np.ndarray, size: float, rows: np.ndarray) -> np.ndarray:
        """Exact inner products, as longs; what a long cannot hold becomes its nearest long."""
        safe = self.size[rows] < EXACT / max(size * self.width, 1.0)
        out = np.zeros(len(rows), np.int64)
        out[safe] = (self.whole[rows[safe]] @ whole).astype(np.int64)
        if not safe.all():
            q = _integers(query)
            for i in np.flatnonzero(~safe):
                exact = sum(a * b for a, b in zip(q, _integers(self.matrix[rows[i]]), strict=True))
                out[i] = min(max(exact, _LEAST), _MOST)
        return out

    def search(self, query_ids: np.ndarray, query: np.ndarray, k: int, found: list[Found]) -> list[Found]:
        """Rows are read from the highest bound down until the k-th exact score, of this block or of one before, is above the next bound."""
        with np.errstate(over="ignore"):
            whole = np.floor(1024.0 * query)
        size = np.abs(whole).max(axis=1)
        far = size >= FAR
        upper = self.bounds(np.where(far[:, None], 0.0, whole))
        upper[far] = np.inf
        # what a long cannot hold is compared as the long that it becomes
        upper = np.minimum(upper, float(_MOST))
        out, step = [], max(32, 2 * k)
        for i, own in enumerate(query_ids):
            ids, scores = found[i]
            bound, left = upper[i], self.ids != own
            near = np.flatnonzero(left & (bound >= scores[-1])) if len(ids) >= k else np.flatnonzero(left)
            if len(near) > 4 * step:  # the highest bounds first, and all others only if those do not settle it
                head = np.argpartition(-bound[near], step)[:step]
                rest = np.ones(len(near), bool)
                rest[head] = False
                ids, scores = self._take(query[i], whole[i], size[i], near[head], ids, scores, k)
                near = near[rest]
                near = near[bound[near] >= scores[-1]]
            near = near[np.argsort(-bound[near], kind="stable")]
            for at in range(0, len(near), step):
                if len(ids) >= k and bound[near[at]] < scores[-1]:
                    break
                ids, scores = self._take(query[i], whole[i], size[i], near[at : at + step], ids, scores, k)
            out.append((ids, scores))
        return out

    def _take(self, query, whole, size, rows, ids, scores, k) -> Found:
        return best(np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.scores(query, whole, size, rows)]), k)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
    for ids, matrix in data_blocks(batches):
        yield Cells(ids, matrix)


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products for every ``every``-th id.

    ``vectors`` has vec_id and embedding; other columns are ignored. Components x become floor(1024 * x); ties go to the
    smaller vec_id; rows with the query's own id are no candidates. Rows whose id or vector is null or empty, or whose
    vector has a null or non-finite component, take no part; an empty table gives none. A score beyond a long becomes the
    nearest long. A block of rows and queries takes a few MB, whatever there is of both.
    """
    rows = usable(vectors)
    found = search(rows, _blocks, rows.where(F.col("vec_id") % every == 0), k, "long")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
