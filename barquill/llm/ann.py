"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquill.functions.tables import materialize
from barquill.llm.vectors import Found, best, by_length, data_blocks, search, usable

#: Bits of a code, and of each of its substrings.
BITS, PART = 128, 16
#: Rows that are indexed together.
INDEX_BLOCK = 1 << 15
#: Rows that codes are learned from (fewer if there are fewer), and rounds of learning.
SAMPLE, ROUNDS = 8192, 25
#: Share of a sampled row's true neighbours in the sample that the radius has to take in.
AIM = 0.96


def lift(matrix: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that makes all as long as the longest, so that nearest in angle is largest in product."""
    scaled = matrix / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


class Codes:
    """A rotation learned from a sample (iterative quantisation), and the Hamming radius that holds the nearest rows."""

    def __init__(self, sample: np.ndarray, norm: float, k: int):
        self.norm = norm
        lifted = lift(sample, norm)
        self.mean = lifted.mean(axis=0)
        centred = lifted - self.mean
        _, basis = np.linalg.eigh(centred.T @ centred)
        basis = np.concatenate([basis[:, ::-1]] * -(-BITS // basis.shape[1]), axis=1)[:, :BITS]
        projected = centred @ basis
        rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(BITS, BITS)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(projected @ rotation).T @ projected)
            rotation = v.T @ u.T
        self.planes = basis @ rotation
        self.radius = self._radius(sample, k)

    def codes(self, matrix: np.ndarray) -> np.ndarray:
        """The substrings of each code, as numbers."""
        return np.packbits((lift(matrix, self.norm) - self.mean) @ self.planes > 0, axis=1).view(np.uint16)

    def query_codes(self, matrix: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
        return np.packbits((np.concatenate([matrix / length, np.zeros_like(length)], axis=1) - self.mean) @ self.planes > 0, axis=1).view(np.uint16)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        asked = sample[:: max(1, len(sample) // 256)]
        products = asked @ sample.T
        near = np.argsort(-products, axis=1, kind="stable")[:, : k + 1]
        apart = distance(self.query_codes(asked)[:, None, :], self.codes(sample)[near])
        return int(np.quantile(apart, AIM, method="higher"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def thresholds(radius: int, parts: int) -> list[int]:
    """How far each substring has to be probed: a code within ``radius`` is within one of these (they and one each make radius + 1)."""
    spare = radius + 1 - parts
    return [spare // parts + (i < spare % parts) for i in range(parts)]


_flips: dict[int, np.ndarray] = {}


def flips(most: int) -> np.ndarray:
    """All substrings with at most ``most`` bits set."""
    if most not in _flips:
        found = [0] if most >= 0 else []
        for n in range(1, min(most, PART) + 1):
            found += [sum(1 << b for b in bits) for bits in combinations(range(PART), n)]
        _flips[most] = np.array(found, np.uint16)
    return _flips[most]


class Index:
    """For each substring, the rows of a block by its value."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray | None = None):
        self.codes = np.ascontiguousarray(codes)
        self.rows = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32) if rows is None else rows
        self.values = [codes[rows, j] for j, rows in enumerate(self.rows)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << PART))]) for j in range(codes.shape[1])]

    def probed(self, j: int, value: int, most: int) -> np.ndarray:
        """Rows whose substring j is at most ``most`` bits from ``value``: from the buckets of all such values, or, if
        there are more of those than rows, from the buckets that are not empty."""
        if len(flips(most)) * 2 > len(self.codes):
            return self.rows[j][np.bitwise_count(self.values[j] ^ value) <= most]
        keys = flips(most) ^ value
        lo, n = self.starts[j][keys], self.starts[j][keys.astype(np.int64) + 1] - self.starts[j][keys]
        some = n > 0
        lo, n = lo[some], n[some]
        return self.rows[j][np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is at most ``radius`` bits from ``code``, by probing buckets of near substrings."""
        hit = np.zeros(len(self.codes), bool)
        for j, most in enumerate(thresholds(radius, len(code))):
            if most >= 0:
                hit[self.probed(j, code[j], most)] = True
        rows = np.flatnonzero(hit)
        whole = np.uint64 if BITS % 64 == 0 else np.uint16  # words of a code that are compared at once
        return rows[distance(self.codes.view(whole)[rows], np.ascontiguousarray(code).view(whole)) <= radius]


class Indexed:
    """Vectors of a block and the index of their codes; without codes, every row is ranked."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, codes: Codes | None, index: Index | None):
        self.ids, self.matrix, self.codes, self.index, self.width = ids, matrix, codes, index, matrix.shape[1]

    def near(self, code: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows within the radius, which is widened where it holds fewer than k."""
        radius = self.codes.radius
        while True:
            rows = self.index.within(code, radius)
            rows = rows[self.ids[rows] != own]
            if len(rows) >= k or radius >= BITS:
                return rows
            radius = min(BITS, radius + 6)

    def search(self, query_ids: np.ndarray, query: np.ndarray, k: int, found: list[Found]) -> list[Found]:
        codes = self.codes.query_codes(query) if self.codes else [None] * len(query)
        out = []
        for code, vector, own, (ids, scores) in zip(codes, query, query_ids, found, strict=True):
            rows = np.flatnonzero(self.ids != own) if code is None else self.near(code, own, k)
            more = np.einsum("ij,j->i", self.matrix[rows], vector)
            out.append(best(np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, more]), k))
        return out


_INDEX = "width int, ids binary, vectors binary, codes binary, rows binary"


def _build(learned: dict[int, Codes]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in data_blocks(batches, INDEX_BLOCK):
            width, codes, rows = matrix.shape[1], b"", b""
            if width in learned:
                made = learned[width].codes(matrix)
                codes, rows = made.tobytes(), Index(made).rows.tobytes()
            row = {"width": width, "ids": ids.astype(np.int64).tobytes(), "vectors": matrix.astype(np.float64).tobytes(), "codes": codes, "rows": rows}
            yield pa.RecordBatch.from_arrays([pa.array([row["width"]], pa.int32()), *(pa.array([row[c]], pa.binary()) for c in ("ids", "vectors", "codes", "rows"))], names=list(row))

    return build


def _blocks(learned: dict[int, Codes]):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Indexed]:
        for batch in batches:
            for width, ids, vectors, codes, rows in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(ids, np.int64)
                index = None
                if codes:
                    made = np.frombuffer(codes, np.uint16).reshape(len(ids), -1)
                    index = Index(made, np.frombuffer(rows, np.int32).reshape(made.shape[1], -1))
                yield Indexed(ids, np.frombuffer(vectors, np.float64).reshape(len(ids), width), learned.get(width), index)

    return blocks


def approximate_top_k(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every ``every``-th id the k largest inner products among the rows found.

    ``vectors`` has vec_id and embedding; other columns are ignored. Codes of 128 bits are learned from at most
    ``sample`` rows (those with the smallest hashes of their ids), as is the Hamming radius: the one that takes in 96 %
    of the nearest rows that sampled rows have in the sample, which is more than it takes for the nearer ones in all rows.
    Every row is indexed by the eight substrings of its code; the index is written once, in blocks. A query probes, in
    each block, all substring values that a code within the radius can have somewhere, keeps the codes within the radius
    and ranks their rows by exact inner product in double precision; where that gives fewer than k rows of a block, the
    radius is widened. In a length of vector so rare that no row of it is in the sample all rows are ranked. Rows with
    the query's own id are no candidates, ties go to the smaller vec_id. Rows with a null id or vector, an empty or zero
    vector, or a null or non-finite component take no part; an empty table gives no rows.
    """
    rows = usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    norms = {r.d: float(r.m) ** 0.5 for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.max(square).alias("m")).collect()}
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).toArrow().combine_chunks()
    learned = {}
    for batch in picked.to_batches():
        for _, matrix in by_length(batch.column(0), batch.column(1)):
            learned[matrix.shape[1]] = Codes(matrix, norms[matrix.shape[1]], k)
    index = materialize(rows.mapInArrow(_build(learned), _INDEX), "index")
    found = search(index, _blocks(learned), rows.where(F.col("vec_id") % every == 0), k, "double")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
