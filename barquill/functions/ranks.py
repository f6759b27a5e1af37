"""Places of values without all of them in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.tables import materialize

#: Ranges that the different values of a key are cut into if there are more than ``CELL_ROWS``. A task may get all columns of a table, so these are few.
CELLS, CELL_ROWS = 256, 1 << 14


def percent_rank(name: str, ascending: bool = True) -> Column:
    """The mean place of equal values over the count of values; null is 0. One task holds the table: for tables of a known size."""
    x = F.col(name)
    order = Window.orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    same, every = Window.partitionBy(name), Window.partitionBy()
    return F.when(x.isNull(), 0.0).otherwise((F.rank().over(order) + (F.count(x).over(same) - 1) / 2) / F.count(x).over(every))


def places(values: DataFrame, by: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """``values`` (by, _v, _n), each different value once, with ``_upto``, how many are not larger, and ``_all``, how many there are of its key.

    A null comes first. Values of keys that have more than ``cell_rows`` of them are cut into ranges by approximate quantiles, counts
    by range say where each begins, and each range is put in order by itself.
    """
    order = Window.partitionBy(*by)
    sizes = values.groupBy(*by).agg(F.count("*").alias("_different"), F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], 10 * CELLS).alias("_cuts"))
    large = materialize(sizes.where(F.col("_different") > cell_rows).select(*by, "_cuts"), "cuts", 1)
    if large.isEmpty():
        return values.withColumn("_upto", F.sum("_n").over(order.orderBy("_v"))).withColumn("_all", F.sum("_n").over(order))
    cell = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    celled = met(values, large, by, "left").withColumn("_cell", cell).drop("_cuts")
    counts = celled.groupBy(*by, "_cell").agg(F.sum("_n").alias("_in"))
    counts = counts.withColumn("_all", F.sum("_in").over(order)).withColumn("_before", F.sum("_in").over(order.orderBy("_cell")) - F.col("_in")).drop("_in")
    within = celled.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_v")))
    within = met(within, counts, [*by, "_cell"]).withColumn("_upto", F.col("_before") + F.col("_upto"))
    return materialize(within.select(*values.columns, "_upto", "_all"), "places")


def percent_ranks(df: DataFrame, wanted: dict[str, tuple[str, bool]], keys: list[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` and for each name in ``wanted`` (a column, whether the smallest comes first) the mean place of equal values over the count.

    Places are those within ``keys``, or in the whole table; a null has rank 0 and is not counted, a null key is a key.
    ``df`` is written once, with a number for each row. The values of all columns are one table: equal ones are counted before
    the shuffle, ``places`` puts them in order, one join gives each row's values their places, and these meet by row, so
    that the steps are as many for twenty columns as for one. The join's large partitions are split by Spark.
    """
    own = [f"_k{i}" for i in range(len(keys or []))]
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    by = [*own, "_q"]
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("_q", "_v")
    pairs = rows.select("_row", *(F.col(k).alias(o) for k, o in zip(keys or [], own, strict=True)), each).where("_v IS NOT NULL")
    values = materialize(pairs.groupBy(*by, "_v").agg(F.count("*").alias("_n")), "values")
    mean = F.col("_upto") - (F.col("_n") - 1) / 2
    found = met(pairs, places(values, by, cell_rows).select(*by, "_v", mean.alias("_mean"), "_all"), [*by, "_v"])
    up, down = F.col("_mean") / F.col("_all"), (F.col("_all") + 1 - F.col("_mean")) / F.col("_all")
    ranks = found.groupBy("_row").agg(*(F.max(F.when(F.col("_q") == columns.index(c), up if first else down)).alias(name) for name, (c, first) in wanted.items()))
    out = rows.join(ranks, "_row", "left").drop("_row")
    return out.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in wanted})


def numbered(df: DataFrame, column: str, name: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` and as ``name`` the place of its value, from 0, among the different values of a column; a null comes first."""
    values = materialize(df.groupBy(F.lit(0).alias("_q"), F.col(column).alias("_v")).agg(F.lit(1).alias("_n")), "values")
    at = places(values, ["_q"], cell_rows).select(F.col("_v").alias(column), (F.col("_upto") - 1).cast("int").alias(name))
    return met(df, at, [column])


def met(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """A join by columns that takes nulls as equal."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, same, how).drop(*(f"_{c}" for c in columns))
