"""Sources mixed to target weights by systematic sampling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquill.functions.tables import materialize
from barquill.llm.names import others, unused

#: Rows of one source and size step that are ranked together, about; and bits of a hash that part them at most.
CELL_ROWS, MOST_BITS = 1 << 12, 16
SEED = "barquill-mix"


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    import numpy as np

    from barquill.llm.words import chunks_of

    counts = [np.diff(words.bounds) for words in chunks_of(text)]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source, null included.

    Sources in order of their code points, null last, get ``weights`` in turn and ``share`` times all words between
    them by weight; a target stops at ``most`` times its source, and what is over goes to the others by weight. Sources
    are taken in the order in which they reach their limit; the level that the rest would share rises until the first
    that stays below its limit and falls after it, so its largest value over running sums settles all targets at once.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("limit", F.col("source_size") * most).withColumn("full_at", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    by_fill = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    rows = rows.withColumn("gone", F.coalesce(F.sum("limit").over(by_fill), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)))
    level = (F.col("total") * share - F.col("gone")) / (F.col("weights") - F.col("used"))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("limit"), F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sizes(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = SEED, counted: DataFrame | None = None) -> DataFrame:
    """Add how many copies of each row the mix takes: columns mix_source_size, mix_target, mix_copies.

    ``rows`` has doc_id, source and mix_size (words); ``counted`` is the same table with only these columns, if that is
    cheaper to read, as it is for whole documents. A row's expected copies are its source's target over its source's
    words. They are summed in order of size (in steps of an eighth of a power of two), then of a hash of doc_id, then of
    doc_id; one offset that a hash of source and seed gives is added, and the row is taken once for each whole number
    that the sum passes, so near every stretch of like sizes its due share is taken. A source without words has target 0
    and gives nothing; null source is a source; null doc_ids are one id to the hash; repeated rows are ranked one after
    the other. Other columns stay, whatever their names; columns of the three names given here are replaced.

    Ranks come from counts of (source, size step, first bits of the hash) cells and a rank inside each cell. There are as
    many bits as it takes for a cell to have about 4000 rows if all were of one source and step, 16 at most (6.5 million
    cells of a source, whose counts one task adds up), so a source that holds a third of all rows is ranked by many tasks;
    how many bits there are does not change the order.
    """
    made = ("mix_source_size", "mix_target", "mix_copies")
    step, place, cell, before, rank, offset, size, target = unused(rows.columns, "step", "place", "cell", "before", "rank", "offset", "size", "target")
    of, of_step, of_cell = unused(rows.columns, "of", "of_step", "of_cell")
    bits = F.length(F.bin("mix_size"))
    stepped = F.when(F.col("mix_size") == 0, F.lit(0).cast("long")).otherwise(bits * 8 + F.expr("shiftright(mix_size, greatest(length(bin(mix_size)) - 3, 0))"))
    counted = rows if counted is None else counted
    first = min(MOST_BITS, (counted.count() // CELL_ROWS).bit_length())
    placed = lambda df: df.withColumn(step, stepped).withColumn(place, _hex(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8)).withColumn(cell, F.shiftright(place, 32 - first) if first else F.lit(0).cast("long"))
    cells = placed(counted).groupBy("source", step, cell).agg(F.count("*").alias("n"), F.sum("mix_size").alias("words"))
    ahead = Window.partitionBy("source").orderBy(step, cell).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    shift = _hex(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("|"), "source"), F.lit(""))), 13) / F.lit(float(1 << 52))
    targets = source_targets(sizes, weights, share, most).withColumn("shift", shift).withColumnRenamed("source", "to")
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(targets, F.col("source").eqNullSafe(F.col("to")))
    cells = cells.select(F.col("source").alias(of), F.col(step).alias(of_step), F.col(cell).alias(of_cell), F.col("ahead").alias(before), F.col("shift").alias(offset), F.col("source_size").alias(size), F.col("target").alias(target))
    inside = Window.partitionBy("source", step, cell).orderBy(place, "mix_size", "doc_id")
    ranked = placed(rows).withColumn(rank, F.row_number().over(inside))
    ranked = ranked.join(cells, F.col("source").eqNullSafe(F.col(of)) & (F.col(step) == F.col(of_step)) & (F.col(cell) == F.col(of_cell)))
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    k = F.col(before) + F.col(rank)
    copies = F.floor(rate * k + F.col(offset)) - F.floor(rate * (k - 1) + F.col(offset))
    return ranked.select(*others(rows.columns, *made), F.col(size).alias("mix_source_size"), F.col(target).alias("mix_target"), F.least(copies, F.ceil(F.lit(most))).cast("long").alias("mix_copies"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and mix_size, the words of the text (null: none), written once."""
    return materialize(docs.select("doc_id", "source", word_count("text").alias("mix_size")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text and others) with mix_size and the columns of ``mix_sizes``; those names are replaced.

    Counts and targets come from a narrow table of sizes that is written once; whole rows move once, to be ranked. Null,
    empty and blank texts have size 0 and are taken as the others of size 0 are; an empty table stays empty.
    """
    rows = docs.select(*others(docs.columns, "mix_size"), word_count("text").alias("mix_size"))
    return mix_sizes(rows, weights, share, most, seed, counted=sized(docs))
