"""What both searches over vectors share: which rows take part, queries in blocks, and the best of many partial lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.tables import materialize

#: Queries that are sent to the executors at once, and bytes of them: fixed numbers, whatever the input.
QUERY_BLOCK, QUERY_BYTES = 4096, 16 << 20
#: Rows of data that are searched at once, and bytes of them; queries that are held against them at once.
DATA_BLOCK, DATA_BYTES, TILE = 1 << 13, 8 << 20, 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows with an id and only finite components; empty vectors go too."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound & (F.size("embedding") > 0))


def by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy()
    for d in np.unique(lengths):
        some = np.flatnonzero(lengths == d)
        flat = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
        yield ids.to_numpy()[some], flat.reshape(len(some), int(d))


def data_blocks(batches: Iterator[pa.RecordBatch], rows: int = DATA_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most about ``rows`` ids and vectors of one length from batches of (vec_id, embedding)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def take(d: int) -> tuple[np.ndarray, np.ndarray]:
        parts = held.pop(d)
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            for ids, matrix in by_length(part.column(0), part.column(1)):
                d = matrix.shape[1]
                held.setdefault(d, []).append((ids, matrix))
                n = sum(len(x[0]) for x in held[d])
                if n >= rows or 8 * n * d >= DATA_BYTES:
                    yield take(d)
    for d in list(held):
        yield take(d)


#: A query's best so far: ids and scores, best first.
Found = tuple[np.ndarray, np.ndarray]


class Block(Protocol):
    """Rows of data of one length of vector."""

    width: int

    def search(self, query_ids: np.ndarray, query: np.ndarray, k: int, found: list[Found]) -> list[Found]:
        """For each query the k best of what was found before and of the block's rows, but for the query's own id."""


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> Found:
    """The k best, highest score first, ties to the smaller id."""
    top = np.lexsort((ids, ~scores if scores.dtype.kind == "i" else -scores))[:k]
    return ids[top], scores[top]


def search(data: DataFrame, blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[Block]], queries: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``data``, cut into ``blocks``, for each row of ``queries``.

    Queries go to the executors in blocks of about 4096 (fewer if they are long) by a hash of their id, one after the
    other; for each block every task searches its own rows, a few hundred queries and a few thousand rows at a time, and
    keeps the k best of them for each query, and those lists meet by query. A repeated query row is answered as often as
    it comes; a vector is compared with those of its own length only.
    """
    spark = data.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    many = max(1, -(-size.n // QUERY_BLOCK), -(-size.n * (size.d or 0) * 8 // QUERY_BYTES))
    kind = {"long": pa.int64(), "double": pa.float64()}[score]
    nothing = (np.zeros(0, np.int64), np.zeros(0, kind.to_pandas_dtype()))
    schema = f"query_no int, query_id long, vec_id long, score {score}"

    def task(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            found: dict[int, Found] = {}
            for block in blocks(batches):
                for numbers, query_ids, query in asked:
                    for lo in range(0, len(query) if query.shape[1] == block.width else 0, TILE):
                        some = numbers[lo : lo + TILE].tolist()
                        now = block.search(query_ids[lo : lo + TILE], query[lo : lo + TILE], k, [found.get(no, nothing) for no in some])
                        found.update(zip(some, now, strict=True))
            for numbers, query_ids, _ in asked:
                for no, query_id in zip(numbers.tolist(), query_ids.tolist(), strict=True):
                    if no in found:
                        got, values = found[no]
                        n = len(got)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, no, np.int32)), pa.array(np.full(n, query_id)), pa.array(got), pa.array(values, kind)], names=["query_no", "query_id", "vec_id", "score"])

        return run

    parts = []
    for b in range(many):
        rows = queries.where(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(7)), F.lit(many)) == b).select("vec_id", "embedding").toArrow().combine_chunks()
        asked, at = [], 0
        for batch in rows.to_batches():
            for ids, matrix in by_length(batch.column(0), batch.column(1)):
                asked.append((np.arange(at, at + len(ids)), ids, matrix))
                at += len(ids)
        part = data.mapInArrow(task(spark.sparkContext.broadcast(asked)), schema)
        order = Window.partitionBy("query_no", "query_id").orderBy(F.col("score").desc(), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(part if many == 1 else materialize(part, "answers"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
