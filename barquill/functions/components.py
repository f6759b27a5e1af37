"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquill.functions.tables import materialize

#: Parts that the rows of one key are dealt into when they meet what it became.
SALTS = 16


def _renamed(rows: DataFrame, column: str, moves: DataFrame, by: str) -> DataFrame:
    """``rows`` with each value of ``column`` that has moved replaced; a value that very many rows have is met in parts.

    Only the moves of values that occur are repeated, once for each part, so they are as few as the distinct values.
    """
    wanted = rows.select(F.col(column).alias("node")).distinct()
    to = moves.join(wanted, "node").select(F.col("node").alias(column), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"), F.col("next").alias("moved"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(to, [column, "salt"], "left").withColumn(column, F.coalesce("moved", column)).select(*rows.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is named by its smallest node.

    Nodes are of any type that has an order. In each round every node moves to the smallest node among itself and its
    neighbours, chains of moves are followed once more, and edges are rewritten to the nodes moved to; edges inside one
    node vanish. Each round is a few hash joins and a minimum by key: a node with very many edges, or a component with
    very many nodes, costs minima that are combined before they are shuffled and joins that are dealt in parts, never a
    gathered list. Rounds grow with the logarithm of the longest path. Loops and repeated edges are harmless; null ends
    are ignored.
    """
    n = edges.count()
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges", n)
    labels, left = None, edges.count()
    if not left:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while left:
        both = edges.union(edges.select("b", "a")).toDF("node", "next")
        least = both.groupBy("node").agg(F.min("next").alias("next"))
        least = materialize(least, "least", 2 * left)
        if labels is None:  # every node is its own component
            labels = least.select("node", F.col("node").alias("component"))
        moves = least.where("next < node")
        moves = materialize(_renamed(moves, "next", moves, "node"), "moves", 2 * left)
        edges = _renamed(_renamed(edges, "a", moves, "b"), "b", moves, "a")
        edges = materialize(edges.where("a <> b").distinct(), "edges", left)
        labels = materialize(_renamed(labels, "component", moves, "node"), "labels", 2 * n)
        left = edges.count()
    return labels
