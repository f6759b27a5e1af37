"""Exact quantiles of a column without all its values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.tables import materialize

#: Values that are put in order together, about.
STEP_ROWS = 1 << 20


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """The quantiles of a column at ``shares``, interpolated as ``percentile`` does; nothing without values.

    Approximate quantiles cut the values into steps, counts say in which steps the wanted places lie, and only the
    distinct values of those steps are put in order, each step by a task, so neither a task nor the driver holds the column.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if not n:
        return None
    steps = min(4096, max(2, n // STEP_ROWS))
    cuts = sorted(set(values.agg(F.percentile_approx("v", [i / steps for i in range(1, steps)], 10 * steps).alias("q")).first().q))
    step = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("v")))
    counted = values.groupBy(step.alias("step"), "v").agg(F.count("*").alias("n"))
    counts = {r.step: r.n for r in counted.groupBy("step").agg(F.sum("n").alias("n")).collect()}
    places = sorted({p for s in shares for p in (int(s * (n - 1)), min(n - 1, int(s * (n - 1)) + 1))})
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    wanted = {k: [p for p in places if before[k] <= p < before[k] + counts[k]] for k in counts}
    some = [k for k in wanted if wanted[k]]
    upto = F.sum("n").over(Window.partitionBy("step").orderBy("v"))
    first = F.create_map(*(F.lit(x) for k in some for x in (k, before[k])))
    rows = counted.where(F.col("step").isin(some)).withColumn("to", upto + first[F.col("step")]).withColumn("from", F.col("to") - F.col("n"))
    asked = F.filter(F.lit(places), lambda p: (p >= F.col("from")) & (p < F.col("to")))
    at = {r.place: r.v for r in rows.select(F.explode(asked).alias("place"), "v").collect()}
    out = []
    for s in shares:
        exact = s * (n - 1)
        low = int(exact)
        high = min(n - 1, low + 1)
        out.append(at[low] if at[low] == at[high] else (high - exact) * at[low] + (exact - low) * at[high] if high > low else at[low])
    return out


#: Steps that the values of a key with more than ``STEP_ROWS`` distinct ones are cut into, and parts that its rows are dealt into.
STEPS, SALTS = 256, 16


def quantiles_by(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, list[float]]], step_rows: int = STEP_ROWS) -> DataFrame:
    """``keys`` and for each name in ``wanted`` (a column and shares) the quantiles of its values by key, as an array of doubles.

    Values are those that ``percentile`` gives, null without any; nulls and NaN are passed over, a null key is a key.
    Equal values are counted before the shuffle. A key with very many different ones has them cut into steps by approximate
    quantiles; counts say which steps hold the wanted places, and only those are put in order, each by a task.
    """
    names = list(wanted)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.col(wanted[name][0]).cast("double").alias("v")) for i, name in enumerate(names))))
    all_ = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), each.alias("x")).select(*(f"k{i}" for i in range(len(keys))), "x.q", "x.v")
    own = [f"k{i}" for i in range(len(keys))]
    by = [*own, "q"]
    every = materialize(all_.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).groupBy(*by, "v").agg(F.count("*").alias("n")), "values")
    values = every.where("v IS NOT NULL")

    def met(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
        """A join by columns that takes nulls as equal."""
        right = right.withColumnsRenamed({c: f"_{c}" for c in columns})
        same = F.lit(True)
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(right, same, how).drop(*(f"_{c}" for c in columns))

    sizes = values.groupBy(*by).agg(F.count("*").alias("different"), F.percentile_approx("v", [i / STEPS for i in range(1, STEPS)], 10 * STEPS).alias("cuts"))
    large = sizes.where(F.col("different") > step_rows).select(*by, "cuts")
    step = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    stepped = met(values, large, by, "left").withColumn("step", step).drop("cuts")
    counts = stepped.groupBy(*by, "step").agg(F.sum("n").alias("in_step"))
    order = Window.partitionBy(*by)
    counts = counts.withColumn("total", F.sum("in_step").over(order)).withColumn("before", F.sum("in_step").over(order.orderBy("step")) - F.col("in_step"))
    shares = F.array(*(F.array(*(F.lit(float(s)) for s in wanted[name][1])) for name in names))[F.col("q")]
    counts = counts.withColumn("exact", F.transform(shares, lambda s: s * (F.col("total") - 1)))
    low = F.transform("exact", lambda e: e.cast("long"))
    high = F.transform("exact", lambda e: F.least(e.cast("long") + 1, F.col("total") - 1))
    inside = F.filter(F.array_union(low, high), lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("in_step")))
    asked = counts.withColumn("places", inside).where(F.size("places") > 0).select(*by, "step", "before", "exact", "places")
    rows = met(stepped, asked, [*by, "step"], "inner").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "step").orderBy("v")))
    hit = F.filter("places", lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
    found = rows.withColumn("hit", hit).where(F.size("hit") > 0).groupBy(*by).agg(
        F.map_from_entries(F.flatten(F.collect_list(F.transform("hit", lambda p: F.struct(p, F.col("v")))))).alias("at"), F.first("exact").alias("exact"), F.max("upto").alias("last")
    )

    def between(e):
        lo = F.element_at("at", e.cast("long"))
        hi = F.element_at("at", e.cast("long") + 1)
        return F.when(hi.isNull() | (e == e.cast("long")) | (lo == hi), lo).otherwise((e.cast("long") + 1 - e) * lo + (e - e.cast("long")) * hi)

    found = found.select(*by, F.transform("exact", between).alias("values"))
    wide = found.groupBy(*own).agg(*(F.max(F.when(F.col("q") == i, F.col("values"))).alias(name) for i, name in enumerate(names)))
    wide = met(every.select(*own).distinct(), wide, own, "left")
    return wide.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *names)


def largest_by(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, top): the n largest values of each key, largest first, nulls left out; a key's rows meet in two rounds."""
    rows = df.select(key, F.col(value).alias("v")).where("v IS NOT NULL").withColumn("salt", (F.rand(5) * SALTS).cast("int"))
    for by in (Window.partitionBy(key, "salt"), Window.partitionBy(key)):
        rows = rows.withColumn("k", F.row_number().over(by.orderBy(F.col("v").desc()))).where(F.col("k") <= n)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("v"), asc=False).alias("top"))
