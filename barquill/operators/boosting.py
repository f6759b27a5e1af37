"""Boosted trees that grow from histograms summed by Spark: classes, or order within groups, stopped by the best scores held out.

Rows never leave their tasks: a task sums gradients by (node, feature, bin), Spark adds the tasks' sums, and the driver
gets nodes * features * bins of them, whatever the table's size. Gradients are whole multiples of 2**-20, so sums, splits
and trees are the same in any order of rows and on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquill.functions.tables import materialize, new_path, remove

#: Margins are told apart to 1 / GRID, within BOUND on both sides, where pairs and precisions are counted.
GRID, BOUND = 256, 16
#: Gradients are rounded to this part of one.
SCALE = 1 << 20
#: Parts that rows of one group and margin are dealt into when they meet their gradients.
SALTS = 8


@dataclass(frozen=True)
class BoostConfig:
    """``pairs`` ranks positives above negatives of the same group, ``logistic`` fits a class; ``fractions`` and ``least_top``
    say which best rows of the validation part count, ``patience`` how many rounds may pass without a better precision."""

    objective: str = "pairs"
    rounds: int = 200
    depth: int = 5
    bins: int = 64
    rate: float = 0.1
    shrink: float = 1.0
    least_rows: int = 20
    fractions: tuple[float, ...] = (0.001, 0.01, 0.05)
    least_top: int = 64
    patience: int = 20


@dataclass
class Tree:
    """Nodes in the order of a heap: children of i are 2 * i + 1 and 2 * i + 2; a node without a feature is a leaf."""

    feature: list[int]
    upto: list[int]
    value: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0] * n, [0.0] * n)

    def reached(self, bins: Column, what=F.lit, i: int = 0) -> Column:
        """The leaf that a row's bins lead to, or ``what`` makes of its number."""
        if self.feature[i] < 0:
            return what(i)
        return F.when(bins[self.feature[i]] <= self.upto[i], self.reached(bins, what, 2 * i + 1)).otherwise(self.reached(bins, what, 2 * i + 2))

    def values(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, upto, value = np.array(self.feature), np.array(self.upto), np.array(self.value)
        while (inner := feature[at] >= 0).any():
            went = np.flatnonzero(inner)
            f = feature[at[went]]
            at[went] = 2 * at[went] + 1 + (x[went, f] > upto[at[went]])
        return value[at]


def binned(columns: tuple[pa.Array, ...], cuts: list[list[float]]) -> np.ndarray:
    """Rows of bins: 0 without a number, else one more than the count of cuts below it. Columns beyond the cuts are passed over."""
    out = np.empty((len(columns[0]), len(cuts)), dtype=np.int16)
    for i, q in enumerate(cuts):
        x = columns[i].to_numpy(zero_copy_only=False).astype(float)
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(np.array(q), x, side="left") + 1)
    return out


def _given(features: list[str]) -> list[Column]:
    """Features as doubles, the first of them twice: a function of one column would get arrays and not tuples."""
    return [F.col(c).cast("double") for c in [*features, features[0]]]


@dataclass
class Forest:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: Mean precision of the best held-out rows after each round that was tried, also of rounds that were dropped again.
    history: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin`` and ``p``, its logistic curve. Missing features are the lowest value."""
        cuts, trees, base = self.cuts, self.trees, self.base

        @F.arrow_udf("double")
        def margin(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                x = binned(batch, cuts)
                yield pa.array(sum((t.values(x) for t in trees), np.full(len(x), base)))

        return df.withColumn("margin", margin(*_given(self.features))).withColumn("p", 1 / (1 + F.exp(-F.col("margin"))))


def _cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    shares = [i / bins for i in range(1, bins)]
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = df.agg(*(F.percentile_approx(known(c), shares).alias(f"q{i}") for i, c in enumerate(features))).first()
    return [sorted(set(q or [])) for q in found]


def _bins(features: list[str], cuts: list[list[float]]) -> Column:
    @F.arrow_udf("array<short>")
    def bins(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            x = binned(batch, cuts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return bins(*_given(features))


def _cell(margin: Column) -> Column:
    return F.round(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), margin)) * GRID).cast("int")


def pair_gradients(counts: pd.DataFrame) -> pd.DataFrame:
    """(y, cell, g, h) of a group from its counts (y, cell, n): for each positive and negative the slope and curve of
    log(1 + exp(-(positive - negative))), divided by how many rows the larger side has. A group of one class has none."""
    counts = counts.sort_values("cell")
    up, down = counts[counts.y == 1], counts[counts.y == 0]
    if up.empty or down.empty:
        return pd.DataFrame({"y": [], "cell": [], "g": [], "h": []})
    whole = max(up.n.sum(), down.n.sum())
    g_up, h_up, g_down, h_down = (np.zeros(n) for n in (len(up), len(up), len(down), len(down)))
    n_down, cells = down.n.to_numpy(float), down.cell.to_numpy(float)
    for at in range(0, len(up), 256):
        part = slice(at, at + 256)
        p = 1 / (1 + np.exp((up.cell.to_numpy(float)[part, None] - cells[None, :]) / GRID))
        n_up = up.n.to_numpy(float)[part]
        g_up[part], h_up[part] = -(p @ n_down), (p * (1 - p)) @ n_down
        g_down += n_up @ p
        h_down += n_up @ (p * (1 - p))
    both = pd.concat([up.assign(g=g_up, h=h_up), down.assign(g=g_down, h=h_down)])
    return both.assign(g=np.rint(both.g / whole * SCALE), h=np.rint(both.h / whole * SCALE))[["y", "cell", "g", "h"]]


def _with_gradients(rows: DataFrame, objective: str) -> DataFrame:
    """Adds g and h, whole numbers; of validation rows they are 0."""
    if objective == "logistic":
        p = 1 / (1 + F.exp(-F.col("margin")))
        part = lambda x: F.when(F.col("val"), 0).otherwise(F.round(x * F.col("w") * SCALE)).cast("long")
        return rows.withColumn("g", part(p - F.col("y"))).withColumn("h", part(p * (1 - p)))
    rows = rows.withColumn("cell", _cell(F.col("margin")))
    counts = rows.where("NOT val").groupBy("grp", "y", "cell").agg(F.count("*").alias("n"))

    def of_group(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        return pair_gradients(counts).assign(grp=key[0])[["grp", "y", "cell", "g", "h"]]

    kind = rows.schema["grp"].dataType.simpleString()
    found = counts.groupBy("grp").applyInPandas(of_group, f"grp {kind}, y int, cell int, g double, h double")
    found = found.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS))))).withColumn("val", F.lit(False))
    salted = rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    met = salted.join(found, ["val", "grp", "y", "cell", "salt"], "left").drop("salt", "cell")
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return met.withColumn("g", whole("g")).withColumn("h", whole("h"))


def _sums(rows: DataFrame, tree: Tree, open_: list[int], width: int, bins: int) -> np.ndarray:
    """g, h and counts by (node of ``open_``, feature, bin), added up by Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(open_) * width * bins
        total = np.zeros((3, size), dtype=np.int64)
        nodes = np.array(open_)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("bins").flatten().to_numpy().reshape(-1, width)
            at = (np.searchsorted(nodes, batch.column("node").to_numpy())[:, None] * width + np.arange(width)) * bins + x
            for k, w in enumerate((batch.column("g").to_numpy(), batch.column("h").to_numpy(), np.ones(len(x)))):
                total[k] += np.rint(np.bincount(at.ravel(), weights=np.repeat(w.astype(float), width), minlength=size)).astype(np.int64)
        some = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (some.astype(np.int64), *total[:, some])], names=["at", "g", "h", "n"])

    asked = rows.where("NOT val").select(tree.reached(F.col("bins")).alias("node"), "bins", "g", "h").where(F.col("node").isin(open_))
    found = asked.mapInArrow(sums, "at long, g long, h long, n long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((3, len(open_) * width * bins), dtype=np.int64)
    out[:, found["at"].to_numpy(np.int64)] = found[["g", "h", "n"]].to_numpy(np.int64).T
    return out.reshape(3, len(open_), width, bins)


def best_split(sums: np.ndarray, shrink: float, least_rows: int) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) from sums (g, h, n) by feature and bin; of equal gains the first."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    worth = lambda s: (s[0] / SCALE) ** 2 / (s[1] / SCALE + shrink)
    gain = worth(left) + worth(right) - worth(whole)
    gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows), np.round(gain, 9), -1.0)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def _grow(rows: DataFrame, width: int, bins: int, c: BoostConfig) -> Tree:
    tree, open_ = Tree.empty(c.depth), [0]
    for _ in range(c.depth):
        sums = _sums(rows, tree, open_, width, bins)
        after = []
        for k, node in enumerate(open_):
            gain, f, b = best_split(sums[:, k], c.shrink, c.least_rows)
            if gain <= 1e-9:
                continue
            tree.feature[node], tree.upto[node] = f, b
            low, whole = sums[:, k, f, : b + 1].sum(axis=1), sums[:, k, f].sum(axis=1)
            for child, s in ((2 * node + 1, low), (2 * node + 2, whole - low)):
                tree.value[child] = float(-c.rate * (s[0] / SCALE) / (s[1] / SCALE + c.shrink))
                after.append(child)
        open_ = after
        if not open_:
            break
    return tree


def top_precision(rows: DataFrame, fractions: tuple[float, ...], least: int) -> float | None:
    """The mean share of positives among the best max(least, round(fraction * n)) rows by ``margin``, over all fractions.

    Rows are counted by margin to 1 / GRID; of equal ones at the border each counts in part. Nothing without rows.
    """
    counts = rows.groupBy(_cell(F.col("margin")).alias("cell")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("cell", ascending=False)
    if counts.empty:
        return None
    n, y = counts.n.to_numpy(float), counts.y.to_numpy(float)
    before = np.cumsum(n) - n
    found = []
    for q in fractions:
        k = min(n.sum(), max(least, round(q * n.sum())))
        found.append(float((np.clip((k - before) / n, 0, 1) * y).sum() / k))
    return sum(found) / len(found)


def fit(df: DataFrame, features: list[str], label: str = "label", group: str | None = None, weight: str | None = None, part: str | None = "part", config: BoostConfig | None = None) -> Forest:
    """Trees fitted on rows whose ``part`` is not ``val``, as many as give the best scores among those whose part is.

    Rows without a label, or for pairs without a ``group``, take no part; a class needs no group and pairs no weight. Without
    validation rows all rounds are kept. Each round writes margins and gradients beside the bins and deletes what the last
    one wrote, so a lost executor costs a re-read of one table.
    """
    c = config or BoostConfig()
    if c.objective not in ("pairs", "logistic"):
        raise ValueError(f"no objective {c.objective}")
    if c.objective == "pairs" and group is None:
        raise ValueError("pairs need a group")
    spark = df.sparkSession
    known = F.col(label).isNotNull() & (F.col(group).isNotNull() if c.objective == "pairs" else F.lit(True))
    val = F.coalesce(F.col(part) == "val", F.lit(False)) if part else F.lit(False)
    cuts = _cuts(df.where(known & ~val), features, c.bins)
    rows = df.where(known).select(
        (F.col(label) >= 0.5).cast("int").alias("y"), val.alias("val"), (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("w"), (F.col(group) if group else F.lit(0)).alias("grp"), _bins(features, cuts).alias("bins")
    )
    rows = materialize(rows, "bins")
    base = 0.0
    if c.objective == "logistic":
        mean = rows.where("NOT val").agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
        base = math.log((mean or 0.5) / (1 - mean)) if mean is not None and 0 < mean < 1 else 0.0
    forest, best, kept, last = Forest(features, cuts, base), -1.0, 0, None
    rows = rows.withColumn("margin", F.lit(base))
    for _ in range(c.rounds):
        path = new_path(spark, "boost")
        _with_gradients(rows, c.objective).write.parquet(path)
        if last:
            remove(spark, last)
        rows, last = spark.read.parquet(path), path
        tree = _grow(rows, len(features), max(len(q) for q in cuts) + 2, c)
        if tree.feature[0] < 0:
            break
        forest.trees.append(tree)
        rows = rows.withColumn("margin", F.col("margin") + tree.reached(F.col("bins"), lambda i, t=tree: F.lit(t.value[i]))).drop("g", "h")
        found = top_precision(rows.where("val"), c.fractions, c.least_top)
        if found is None:
            kept = len(forest.trees)
            continue
        forest.history.append(found)
        if found > best:
            best, kept = found, len(forest.trees)
        elif len(forest.trees) - kept >= c.patience:
            break
    if last:
        remove(spark, last)
    forest.trees = forest.trees[:kept]
    return forest
