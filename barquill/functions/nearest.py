"""Near points of a table of points, by the leaves of a k-d tree: exact k nearest, and groups that short steps connect.

The tree comes from a bounded sample and only says who is worth comparing: whatever its shape, results are exact. Points
at one place count as one, so tables with many equal points have small leaves too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.components import connected_components
from barquill.functions.tables import materialize

#: Points of a leaf, about; leaves at most; points that the tree is made from at most; points held against a leaf at once.
LEAF, LEAVES, SAMPLE, TILE = 512, 4096, 1 << 16, 256
#: Other leaves that a leaf is held against before it is asked what is still apart.
FIRST = 6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1 if len(column) else 1)


class Tree:
    """Splits at medians of the widest part, down to leaves that about the same share of a sample falls into."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int]] = []  # part, value, node or ~leaf below it, and from it on
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        wide = x.max(axis=0) - x.min(axis=0) if len(x) and x.shape[1] else np.zeros(1)
        if leaves <= 1 or len(x) < 2 or not wide.max() > 0:
            self.leaves += 1
            return ~(self.leaves - 1)
        part = int(wide.argmax())
        cut = float(np.median(x[:, part]))
        low = x[:, part] < cut
        if not low.any():  # more than half are the least value
            cut = float(x[x[:, part] > cut, part].min())
            low = x[:, part] < cut
        at = len(self.splits)
        self.splits.append((part, cut, 0, 0))
        below, above = self._grow(x[low], leaves // 2), self._grow(x[~low], leaves - leaves // 2)
        self.splits[at] = (part, cut, below, above)
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            part, cut, below, above = self.splits[node]
            low = x[rows, part] < cut
            todo += [(below, rows[low]), (above, rows[~low])]
        return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each point is from each box, never more than from any point in it."""
    off = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
    return np.sqrt((off**2).sum(axis=2)) * (1 - 1e-12)


def _placed(points: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Members (id, place), places (place, x, leaf) and, of each leaf that has any, its number and the corners of its box.

    A place is called by the least id of the points there.
    """
    rows = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    rows = materialize(rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0))), "points")  # minus zero is zero
    places = materialize(rows.groupBy("x").agg(F.min("id").alias("place")), "places")
    n = places.count()
    sample = _matrix(places.orderBy(F.xxhash64("place")).limit(SAMPLE).select("x").toArrow().column(0)) if n else np.zeros((0, 1))
    sent = points.sparkSession.sparkContext.broadcast(Tree(sample, min(LEAVES, -(-n // leaf))))

    @F.arrow_udf("int")
    def leaf_of(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.leaf_of(_matrix(x)) if len(x) else np.zeros(0, np.int32))

    placed = materialize(places.withColumn("leaf", leaf_of("x")), "leaves")
    ends = placed.select("leaf", F.posexplode("x").alias("i", "v")).groupBy("leaf", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    boxes = sorted((r.leaf, [(e.i, e.lo, e.hi) for e in r.e]) for r in ends.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("e")).collect())
    low, high = (np.array([[e[k] for e in b] for _, b in boxes], float).reshape(len(boxes), -1 if boxes else 1) for k in (1, 2))
    members = rows.join(places, "x").select("id", "place")
    return members, placed, np.array([no for no, _ in boxes], np.int32), low, high


def _near(query: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k nearest of x: distances and ids, ties to the smaller id."""
    out = []
    for at in range(0, len(query), TILE):
        apart = _distance(query[at : at + TILE], x)
        for far in apart:
            some = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
            some = some[np.lexsort((ids[some], far[some]))[:k]]
            out.append((far[some], ids[some]))
    return out


def k_nearest(points: DataFrame, k: int, leaf: int = LEAF, compared: Accumulator | None = None) -> DataFrame:
    """(a, b, distance, rank) of the k points nearest to each point (id, x), itself left out; ties to the smaller id.

    The nearest of a point's own leaf bound how far it has to look; then it asks the leaves whose boxes are no farther, in
    groups of a bounded size, and the nearest of all leaves meet by point. Rows without id or x take no part. ``compared``
    counts distances.
    """
    members, placed, leaves, low, high = _placed(points, leaf)
    most = k + 1  # a place and its k nearest have k ids besides the asker's own

    def reach(table: pa.Table) -> pa.Table:
        ids, x = table.column("place").to_numpy(), _matrix(table.column("x"))
        if compared is not None:
            compared.add(len(x) * len(x))
        far = [found[0][most - 1] if len(found[0]) == most else np.inf for found in _near(x, ids, x, most)]
        asked, leaf_no = [], []
        for at in range(0, len(x), TILE):
            row, box = np.nonzero(_to_boxes(x[at : at + TILE], low, high) <= np.array(far[at : at + TILE])[:, None])
            asked.append(row + at)
            leaf_no.append(leaves[box])
        rows = pa.array(np.concatenate(asked))
        return pa.table({"place": table.column("place").take(rows), "x": table.column("x").take(rows), "leaf": np.concatenate(leaf_no)})

    asks = materialize(placed.groupBy("leaf").applyInArrow(lambda table: reach(table), "place long, x array<double>, leaf int"), "asks")
    parts = asks.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(16 * leaf)).cast("int").alias("parts"))
    asks = asks.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
    held = placed.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def answer(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not len(queries) or not len(data):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if compared is not None:
            compared.add(len(queries) * len(data))
        found = _near(_matrix(queries.column("x")), data.column("place").to_numpy(), _matrix(data.column("x")), most)
        a = np.repeat(queries.column("place").to_numpy(), [len(f[0]) for f in found])
        return pa.table({"a": a, "b": np.concatenate([f[1] for f in found]), "distance": np.concatenate([f[0] for f in found])})

    met = asks.select("leaf", "part", "place", "x").groupBy("leaf", "part").cogroup(held.select("leaf", "part", "place", "x").groupBy("leaf", "part"))
    found = met.applyInArrow(lambda queries, data: answer(queries, data), "a long, b long, distance double")
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("k") <= most)
    # of the points at each place the least ids, as many as anyone can ask for, in two rounds
    few = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    for by in (Window.partitionBy("place", "salt"), Window.partitionBy("place")):
        few = few.withColumn("no", F.row_number().over(by.orderBy("id"))).where(F.col("no") <= most)
    near = found.join(few.select(F.col("place").alias("b"), "id"), "b").select("a", "distance", F.col("id").alias("b"))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("k") <= most)
    near = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("distance", "b"))).alias("near"))
    each = members.join(near.withColumnRenamed("a", "place"), "place")
    others = F.slice(F.filter("near", lambda p: p["b"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("a"), F.posexplode(others).alias("rank", "p")).select("a", "p.b", "p.distance", (F.col("rank") + 1).alias("rank"))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each is connected with."""
    least = np.arange(n)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            return least
        least = now


def grouped(points: DataFrame, radius: float, leaf: int = LEAF, compared: Accumulator | None = None) -> DataFrame:
    """(id, component): points (id, x) that steps of at most ``radius`` connect, named by the least id.

    First the points of each leaf are grouped by themselves. Then leaves no farther than the radius meet, each its few
    nearest, and only points of different groups that reach into the other's box are compared; one link for two groups is
    enough. Pairs of leaves whose points are by then all in one group are left out, the others meet too. Rows without id
    or x take no part.
    """
    members, placed, leaves, low, high = _placed(points, leaf)
    spark = points.sparkSession

    def inside(table: pa.Table) -> pa.Table:
        ids, x = table.column("place").to_numpy(), _matrix(table.column("x"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        if compared is not None:
            compared.add(len(x) * len(x))
        links = [np.nonzero(_distance(x[at : at + TILE], x) <= radius) for at in range(0, len(x), TILE)]
        least = _joined(len(x), np.concatenate([i + TILE * t for t, (i, _) in enumerate(links)]), np.concatenate([j for _, j in links]))
        return pa.table({"place": ids, "x": pa.array(list(x), pa.list_(pa.float64())), "leaf": table.column("leaf").take(pa.array(order)), "comp": ids[least]})

    held = materialize(placed.groupBy("leaf").applyInArrow(lambda table: inside(table), "place long, x array<double>, leaf int, comp long"), "held")
    off = [np.sqrt((np.maximum(np.maximum(low[i] - high, low - high[i]), 0.0) ** 2).sum(axis=1)) * (1 - 1e-12) for i in range(len(leaves))]
    middle = (low + high) / 2
    first, rest = set(), set()
    for i in range(len(leaves)):
        close = [j for j in np.argsort(((middle - middle[i]) ** 2).sum(axis=1), kind="stable").tolist() if j != i and off[i][j] <= radius]
        first |= {(min(i, j), max(i, j)) for j in close[:FIRST]}
        rest |= {(min(i, j), max(i, j)) for j in close[FIRST:]}

    def between(table: pa.Table) -> pa.Table:
        side, comp, x = table.column("side").to_numpy(), table.column("comp").to_numpy(), _matrix(table.column("x"))
        links: set[tuple[int, int]] = set()
        one, two = (np.flatnonzero(side == s) for s in (0, 1))
        for mine, other in ((one, two), (two, one)):  # those that reach the other's box
            if len(mine) and len(other):
                near = _to_boxes(x[mine], x[other].min(axis=0)[None], x[other].max(axis=0)[None])[:, 0] <= radius
                one, two = (mine[near], two) if mine is one else (one, mine[near])
        for at in range(0, len(one), TILE):
            rows = one[at : at + TILE]
            left = two[np.array([any((a, b) not in links and a != b for a in np.unique(comp[rows]).tolist()) for b in comp[two].tolist()], bool)] if len(two) else two
            if not len(left):
                continue
            if compared is not None:
                compared.add(len(rows) * len(left))
            i, j = np.nonzero(_distance(x[rows], x[left]) <= radius)
            links |= {(a, b) for a, b in set(zip(comp[rows[i]].tolist(), comp[left[j]].tolist(), strict=True)) if a != b}
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def linked(rows: DataFrame, pairs: set[tuple[int, int]]) -> DataFrame:
        sides = [(no, s, int(leaves[p[s]])) for no, p in enumerate(sorted(pairs)) for s in (0, 1)]
        meets = rows.join(F.broadcast(spark.createDataFrame(sides, "pair long, side int, leaf int")), "leaf")
        return materialize(meets.select("pair", "side", "comp", "x").groupBy("pair").applyInArrow(lambda table: between(table), "a long, b long"), "links")

    def moved(rows: DataFrame, links: DataFrame) -> DataFrame:
        roots = connected_components(links).select(F.col("node").alias("comp"), "component")
        return rows.join(roots, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")

    if first:
        held = materialize(moved(held, linked(held, first)), "held")
    if rest:
        whole = {r.leaf: (r.n, r.comp) for r in held.groupBy("leaf").agg(F.count_distinct("comp").alias("n"), F.min("comp").alias("comp")).collect()}
        one = lambda i, j: whole[int(leaves[i])][0] == 1 and whole[int(leaves[i])] == whole[int(leaves[j])]
        rest = {p for p in rest if not one(*p)}
        if rest:
            held = moved(held, linked(held, rest))
    return members.join(held.select("place", F.col("comp").alias("component")), "place").select("id", "component")
