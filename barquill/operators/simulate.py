"""What signals would have earned: the trade that each bar would open, common windows, correlations, paper accounts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """How a position is entered and left."""

    tau: float = 0.6
    span: int = 12
    offset: float = 0.0
    confirm: int = 1
    cost_side: float = 0.001


def candidates(scored: DataFrame, c: Contract, max_hold: int = 288) -> DataFrame:
    """Every bar that could be entered, with the trade it would open: (symbol, entry_ts, exit_ts, r_net, score, reason).

    The walk to the exit is a fold over at most ``max_hold`` bars ahead, in Spark.
    """
    by = Window.partitionBy("symbol").orderBy("ts")
    alpha = 2.0 / (c.span + 1.0)
    rows = scored.where("close > 0").withColumn("_ahead", F.collect_list(F.struct("ts", "close")).over(by.rowsBetween(1, max_hold)))
    rows = rows.where((F.col("p_entry") >= c.tau) & (F.size("_ahead") > 0))
    start = F.struct((F.col("close") * (1 - c.offset)).alias("ema"), F.lit(0).alias("streak"), F.lit(False).alias("out"), F.col("close").alias("px"), F.col("ts").alias("ts"))

    def step(acc: Column, x: Column) -> Column:
        ema = acc["ema"] + alpha * (x["close"] - acc["ema"])
        streak = F.when(x["close"] < ema, acc["streak"] + 1).otherwise(0)
        return F.when(acc["out"], acc).otherwise(F.struct(ema.alias("ema"), streak.alias("streak"), (streak >= max(1, c.confirm)).alias("out"), x["close"].alias("px"), x["ts"].alias("ts")))

    rows = rows.withColumn("_w", F.aggregate("_ahead", start, step))
    net = F.col("_w.px") / F.col("close") - 1 - 2 * c.cost_side
    return rows.select("symbol", F.col("ts").alias("entry_ts"), F.col("_w.ts").alias("exit_ts"), net.alias("r_net"), F.col("p_entry").alias("score"), F.when(F.col("_w.out"), "EMA").otherwise("EOD").alias("reason"))


def common_window(bars: DataFrame, least_rows: int = 1000, earliest: bool = True) -> DataFrame:
    """Bars of symbols with enough rows, up to the earliest (or latest) of their last times."""
    ends = bars.groupBy("symbol").agg(F.max("ts").alias("_end"), F.count("*").alias("_n")).where(F.col("_n") >= least_rows)
    end = (F.min if earliest else F.max)("_end").over(Window.partitionBy())
    return bars.join(ends.withColumn("_cut", end).select("symbol", "_cut"), "symbol").where(F.col("ts") <= F.col("_cut")).drop("_cut")


def rolling_correlation(pairs: DataFrame, n: int, least: int) -> DataFrame:
    """Adds ``correlation`` of columns a and b over n rows of a key, null with fewer than ``least`` pairs or if either does not vary."""
    w = Window.partitionBy("key").orderBy("ts").rowsBetween(-(n - 1), 0)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    spread = F.stddev_pop(F.when(both, F.col("a"))).over(w) * F.stddev_pop(F.when(both, F.col("b"))).over(w)
    return pairs.withColumn("correlation", F.when(F.count(F.when(both, 1)).over(w) >= least, F.try_divide(F.covar_pop("a", "b").over(w), spread)))


def paper_account(fills: DataFrame, cash: float = 10_000.0, fee: float = 0.001) -> DataFrame:
    """Cash, quantity and equity after each fill (account, ts, n, qty, price); qty is negative for sales and shorts."""
    w = Window.partitionBy("account").orderBy("ts", "n").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("qty") * F.col("price")
    rows = fills.withColumn("cash", cash - F.sum(value + F.abs(value) * fee).over(w)).withColumn("held", F.sum("qty").over(w))
    return rows.withColumn("equity", F.col("cash") + F.col("held") * F.col("price"))


def lot(qty: Column, step: float) -> Column:
    """A quantity in whole lots."""
    return F.floor(qty / step + 1e-9) * step
