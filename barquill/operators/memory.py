"""What the groups of settings that earlier steps chose say about those of a later step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from barquill.functions.ranks import CELL_ROWS, percent_rank, percent_ranks
from barquill.functions.tables import new_path

#: Parts that the groups of one step are dealt into.
PARTS = 16
MEMORY = "step double, place int, id string, center array<double>, quality double"

# How fast nearness falls with distance, for clusters and for families, and the weights of what they are scored by.
CLUSTER_RATE, FAMILY_RATE = 3.2, 3.0
CLUSTER_WEIGHTS, FAMILY_WEIGHTS = (0.72, 0.20, 0.08), (0.74, 0.20, 0.06)


def nearness(center: Column, step: Column, held: list, rate: float, step_days: float) -> tuple[Column, Column]:
    """How near a group is to what is held: the mean of the four nearest, weighed by quality, and how many steps have one nearer than 0.55."""
    if not held:
        return F.lit(0.0), F.lit(0.0)
    entries = F.array(*(F.struct(F.lit(float(m.step)).alias("step"), F.array(*(F.lit(float(x)) for x in m.center)).alias("center"), F.lit(float(m.quality)).alias("quality")) for m in held))
    square = lambda m: F.aggregate(F.zip_with(center, m["center"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    apart = lambda m: F.greatest(F.lit(1.0), F.abs(m["step"] - step) / step_days) - 1
    near = F.transform(entries, lambda m: F.struct(F.exp(-rate * F.sqrt(square(m)) - 0.30 * apart(m)).alias("near"), m["step"].alias("step"), m["quality"].alias("quality")))
    top = F.slice(F.sort_array(F.transform(near, lambda m: m["near"] * (0.75 + 0.25 * m["quality"])), asc=False), 1, 4)
    mean = F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)
    seen = F.size(F.array_distinct(F.transform(F.filter(near, lambda m: m["near"] >= 0.55), lambda m: m["step"])))
    return F.when(center.isNull(), 0.0).otherwise(mean), F.when(center.isNull(), 0.0).otherwise(seen.cast("double"))


def over_steps(
    groups: DataFrame, memory: DataFrame | None = None, rate: float = CLUSTER_RATE, weights: tuple[float, float, float] = CLUSTER_WEIGHTS, n: int = 3, limit: int = 24, step_days: float = 180.0, cell_rows: int = CELL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Groups (step, id, center, base) of all steps, scored in the order of steps by what the steps before remember; and the memory after the last.

    Scores, to twelve places, are ``weights`` times base, the rank of the continuity and the rank of the coverage among the step's groups. The n best
    of a step (ties to the larger base, then the smaller id) are remembered with their scores, the last ``limit`` of them
    count. Added are causal_continuity, causal_coverage_steps, causal_score and place, which is null for groups that are not
    remembered. ``memory``, as this returns it, lets a later run go on where an earlier one ended: steps that it holds or
    that are older than its last are not to be given again.

    Steps follow one another by what they choose, so each is a few Spark jobs of its own, over one part of a table that is
    written once by step; between them the driver holds the memory, ``limit`` rows at most, and the numbers of the steps. A
    step with more than ``cell_rows`` groups is ranked by many tasks. Groups without a step are left out; (step, id) names a
    group once. One without a center has no continuity and is not remembered; a null base counts as 0. Centers of all groups
    have the same length.
    """
    spark = groups.sparkSession
    stored, scored = new_path(spark, "groups"), new_path(spark, "causal")
    as_double = lambda c: F.col(c).cast("double")
    rows = groups.select(as_double("step").alias("step"), F.col("id").cast("string").alias("id"), F.col("center").cast("array<double>").alias("center"), F.coalesce(as_double("base"), F.lit(0.0)).alias("base"))
    rows = rows.where("step IS NOT NULL AND NOT isnan(step)").withColumn("at", F.col("step").cast("string"))
    rows.repartition("at", F.pmod(F.xxhash64("id"), F.lit(PARTS))).write.partitionBy("at").parquet(stored)
    table = spark.read.schema(rows.schema).parquet(stored)
    held = memory.orderBy(F.col("step").desc(), F.col("place").desc()).limit(limit).collect()[::-1] if memory is not None else []
    steps = table.groupBy("step", "at").count().orderBy("step").collect()
    if held and steps and steps[0].step <= held[-1].step:
        raise ValueError(f"step {steps[0].step} is not after the last step remembered, {held[-1].step}")
    chosen, paths = [], []
    for step, at, size in steps:
        continuity, coverage = nearness(F.col("center"), F.col("step"), held, rate, step_days)
        part = table.where(F.col("at") == at).drop("at").withColumn("causal_continuity", F.round(continuity, 12)).withColumn("causal_coverage_steps", coverage)
        if size <= cell_rows:
            part = part.withColumn("_near", percent_rank("causal_continuity")).withColumn("_seen", percent_rank("causal_coverage_steps"))
        else:
            part = percent_ranks(part, {"_near": ("causal_continuity", True), "_seen": ("causal_coverage_steps", True)}, cell_rows=cell_rows)
        score = F.col("base") * weights[0] + F.col("_near") * weights[1] + F.col("_seen") * weights[2]
        part = part.withColumn("causal_score", F.round(score, 12)).drop("_near", "_seen")
        paths.append(f"{scored}/{at}")
        part.write.parquet(paths[-1])
        best = spark.read.schema(part.schema).parquet(paths[-1]).where("center IS NOT NULL").orderBy(F.col("causal_score").desc(), F.col("base").desc(), "id").limit(n).collect()
        new = [Row(step=step, place=i + 1, id=r.id, center=r.center, quality=r.causal_score) for i, r in enumerate(best)]
        chosen += new
        held = [*held, *new][-limit:]
    schema = "step double, id string, center array<double>, base double, causal_continuity double, causal_coverage_steps double, causal_score double"
    every = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    places = spark.createDataFrame(chosen, MEMORY).select("step", "id", "place")
    return every.join(places, ["step", "id"], "left"), spark.createDataFrame(held, MEMORY)
