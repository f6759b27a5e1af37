"""Settings to try: grids, low-discrepancy sequences, refinement, results of many symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.functions.quantiles import quantiles_by
from barquill.functions.tables import materialize
from barquill.operators import select


def van_der_corput(index: Column, base: int, digits: int = 24) -> Column:
    """The index's digits mirrored behind the point."""
    steps = F.sequence(F.lit(0), F.lit(digits - 1))
    at = lambda k: F.pow(F.lit(float(base)), k)
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.floor(index / at(k)) % base / at(k + 1))


def permuted_grid(spark: SparkSession, sizes: Sequence[int], n: int, stride: int) -> DataFrame:
    """(ordinal, i0, i1, ...): n cells of a grid, spread by (ordinal * stride) mod cells."""
    total = 1
    for s in sizes:
        total *= s
    rows = spark.range(n).select(F.col("id").alias("ordinal"), (F.col("id") * stride % total).alias("cell"))
    out, below = [], total
    for i, s in enumerate(sizes):
        below //= s
        out.append((F.floor(F.col("cell") / below) % s).cast("int").alias(f"i{i}"))
    return rows.select("ordinal", *out)


def sampled_choice(choices: Sequence, index: int, base: int, salt: int = 0):
    """One of the choices by the van der Corput number of an index."""
    i, out, denominator = max(1, index + salt), 0.0, 1.0
    while i:
        i, digit = divmod(i, base)
        denominator *= base
        out += digit / denominator
    return choices[min(len(choices) - 1, int(out * len(choices)))]


def neighbours(choices: Sequence[float], centre: float, radius: int) -> Sequence[float]:
    """The choices within ``radius`` places of the one nearest to ``centre``."""
    at = min(range(len(choices)), key=lambda i: abs(choices[i] - centre))
    return choices[max(0, at - radius) : at + radius + 1]


def per_days(ret: Column, days: Column, to: float = 180.0) -> Column:
    """A growth of equity over some days as that over ``to`` days."""
    return F.pow(F.greatest(ret + 1, F.lit(1e-9)), to / F.greatest(days, F.lit(1.0))) - 1


def fitness() -> Column:
    """Geometric mean of margins over least demands, lowered by drawdown and few trades. Columns ret_pct, max_dd, profit_factor, win_rate, trades."""
    margin = lambda x, low, high: F.greatest(F.lit(1e-6), F.least(F.lit(1.0), (x - low) / (high - low)))
    product = margin(F.col("ret_pct"), 0.0, 0.6) * margin(F.col("profit_factor"), 1.0, 3.0) * margin(F.col("win_rate"), 0.3, 0.7)
    return F.pow(product, F.lit(1 / 3)) * F.exp(-6.0 * F.greatest(F.lit(0.0), F.col("max_dd") - 0.10)) * F.least(F.lit(1.0), F.col("trades") / 60)


def averaged(results: DataFrame, key: str) -> DataFrame:
    """One result for each key from those of its symbols: means, how many symbols, and trades in all; whole numbers are cut off."""
    whole = lambda c: F.avg(c).cast("long").alias(c)
    means = (F.avg(c).alias(c) for c in ("fitness", "eq_end", "max_dd", "profit_factor", "win_rate", "neg_month_ratio"))
    return results.groupBy(key).agg(*means, whole("trades"), whole("neg_months"), F.count("*").alias("symbols"), F.sum("trades").alias("trades_total"), F.avg("trades").alias("trades_avg"))


# Weights of a cluster's score, size and drawdown ranks.
SEED_WEIGHTS = {"score_q25": 0.55, "size": 0.25, "-dd_median": 0.20}


def refine_seeds(runs: DataFrame, columns: list[str], generation: int, radius: float, n: int = 6) -> DataFrame:
    """The best settings of the n best clusters among the backtests of earlier generations: where to look more closely.

    ``runs`` has id, stage, status, generation, score, max_dd and ``columns``, which are scaled to 0 .. 1 (missing ones
    as the median) and clustered by ``radius``. A cluster's score is a mean of ranks; its best setting is that with the
    highest score, of equals the one nearest to the cluster's middle.
    """
    done = runs.where("stage = 'backtest' AND status = 'ok'").where((F.coalesce("generation", F.lit(0)) < generation) & F.col("score").isNotNull())
    rows = select.clustered(select.scaled(done, columns), radius)
    rows = rows.join(select.centres(rows, "cluster_id"), "cluster_id").withColumn("cluster_dist", select.apart(F.col("x"), F.col("center")))
    rows = materialize(rows, "runs")
    middles = quantiles_by(rows.withColumn("_dd", F.coalesce("max_dd", F.lit(1.0))), ["cluster_id"], {"_q": ("score", [0.25]), "_m": ("_dd", [0.5])})
    stats = middles.select("cluster_id", F.col("_q")[0].alias("score_q25"), F.col("_m")[0].alias("dd_median")).join(rows.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    stats = select.with_places(stats, SEED_WEIGHTS)
    score = F.lit(0.0)
    for name, weight in SEED_WEIGHTS.items():
        score = score + F.col(select.place(name)) * weight
    best = select.without_places(stats.withColumn("cluster_score", score)).orderBy(F.col("cluster_score").desc(), F.col("score_q25").desc(), F.col("size").desc(), "cluster_id").limit(n)
    top = select.pick(rows, [F.col("score").desc(), F.col("cluster_dist"), F.col("id")], 1, "cluster_id")
    return top.join(best.select("cluster_id", "cluster_score", "size"), "cluster_id").select("cluster_id", "cluster_score", "size", "id", "score", *columns)
