"""Which symbols to trade: market caps, history, hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def market_caps(lines: DataFrame) -> DataFrame:
    """(symbol, cap) from lines ``SYMBOL: 1.234.567`` in column value; comments and others are left out."""
    parts = lambda i: F.regexp_extract("value", r"^\s*([A-Za-z0-9_.\-]+)\s*:\s*([\d.,_ ]+)\s*$", i)
    rows = lines.where(~F.col("value").rlike(r"^\s*#")).select(F.upper(parts(1)).alias("symbol"), F.translate(parts(2), "., _", "").alias("digits"))
    return rows.where("symbol <> '' and digits <> ''").select("symbol", F.col("digits").try_cast("double").alias("cap")).where("cap is not null")


def top_caps(caps: DataFrame, least: float = 0.0, most: float | None = None, n: int | None = None, exclude: DataFrame | None = None, suffix: str = "") -> DataFrame:
    rows = caps.where(F.col("cap") >= least)
    rows = rows.where(F.col("cap") <= most) if most is not None else rows
    rows = rows.join(exclude, "symbol", "left_anti") if exclude is not None else rows
    rows = rows.orderBy(F.col("cap").desc(), "symbol")
    rows = rows.limit(n) if n else rows
    return rows.select(F.when(F.col("symbol").endswith(suffix), F.col("symbol")).otherwise(F.concat("symbol", F.lit(suffix))).alias("symbol"), "cap")


def discovered(pairs: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tradable pairs (base, status) with the largest cap that a feed (symbol, cap) has for their base; and those without one."""
    live = pairs.where("status = 'TRADING'").select(F.lower("base").alias("base")).distinct()
    best = feed.groupBy(F.lower("symbol").alias("base")).agg(F.max("cap").alias("cap"))
    return live.join(best, "base"), live.join(best, "base", "left_anti")


def is_stable(symbol: Column) -> Column:
    return F.upper(symbol).rlike(r"^(USDC|USDT|BUSD|TUSD|FDUSD|DAI|USDP|EUR|GBP|USD1|USDE)(USDT|USDC)?$")


def without(df: DataFrame, denied: DataFrame) -> DataFrame:
    return df.join(denied.select("symbol").distinct(), "symbol", "left_anti")


def history(trades: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """By symbol: trades, pnl, gains, losses and wins of those that closed in a period (from start, before end)."""
    rows = trades
    if start:
        rows = rows.where(F.col("exit_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("exit_ts") < F.lit(end).cast("timestamp_ntz"))
    w = F.col("r_net") * F.col("weight")
    return rows.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.sum(w).alias("pnl"), F.sum(F.when(w > 0, w).otherwise(0.0)).alias("gains"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("losses"), F.avg((w > 0).cast("double")).alias("win_rate")
    )


def shrunk(stats: DataFrame, k: float = 20.0, prior_pf: float = 1.0, prior_win: float = 0.5) -> DataFrame:
    """Adds trust (n / (n + k)) and profit factor and win rate drawn to their priors where trades are few."""
    trust = F.col("trades") / (F.col("trades") + k)
    pf = F.least(F.lit(10.0), F.col("gains") / F.greatest(F.col("losses"), F.lit(1e-9)))
    return stats.withColumn("trust", trust).withColumn("eff_pf", trust * pf + (1 - trust) * prior_pf).withColumn("eff_win", trust * F.col("win_rate") + (1 - trust) * prior_win).withColumn(
        "symbol_score", F.log(F.col("eff_pf") + 1e-9) + 0.5 * (F.col("eff_win") - 0.5) + 0.1 * F.col("pnl")
    )


def smoothed_over_steps(scores: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(symbol, ewm): exponential average of scores (symbol, step, score) over steps, folded in Spark over a symbol's few steps."""
    steps = scores.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("step", "score"))).alias("s"))
    fold = F.aggregate(F.slice(F.col("s"), 2, 1 << 30), F.col("s")[0]["score"], lambda a, x: (1 - alpha) * a + alpha * x["score"])
    return steps.select("symbol", fold.alias("ewm"))


def hysteresis(scores: DataFrame, previous: DataFrame, enter: float, leave: float, least_trades: int, max_changes: int, min_active: int) -> DataFrame:
    """(symbol, active, reason) for the next step.

    An active symbol is dropped under ``leave``, an inactive one comes in over ``enter``; too few trades keep what was
    (warm-up); at most ``max_changes`` of each are made, the plainest first; and if fewer than ``min_active`` stay, the best
    others come in.
    """
    rows = scores.join(previous.select("symbol", F.col("active").alias("was")), "symbol", "left").withColumn("was", F.coalesce("was", F.lit(False)))
    thin = F.col("trades") < least_trades
    rows = rows.withColumn("wish", F.when(thin, F.lit("keep")).when(F.col("was") & (F.col("score") < leave), "drop").when(~F.col("was") & (F.col("score") > enter), "add").otherwise("keep"))
    distance = F.when(F.col("wish") == "drop", F.col("score")).otherwise(-F.col("score"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("wish").orderBy(distance, "symbol")))
    changed = (F.col("wish") != "keep") & (F.col("turn") <= max_changes)
    rows = rows.withColumn("active", F.when(changed, F.col("wish") == "add").otherwise(F.col("was")))
    rows = rows.withColumn("n_active", F.sum(F.col("active").cast("int")).over(Window.partitionBy()))
    rows = rows.withColumn("fill", F.row_number().over(Window.partitionBy("active").orderBy(F.col("score").desc(), "symbol")))
    filled = ~F.col("active") & (F.col("fill") <= F.greatest(F.lit(0), F.lit(min_active) - F.col("n_active")))
    reason = F.when(filled, "fill").when(changed, F.col("wish")).when(thin, "warm-up").otherwise("keep")
    return rows.select("symbol", (F.col("active") | filled).alias("active"), reason.alias("reason"))


def windows(start: str, end: str, days: int, spark) -> DataFrame:
    """(step, step_start, step_end): stretches of ``days`` that follow each other without overlap."""
    rows = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}' - INTERVAL '{days}' DAY, INTERVAL '{days}' DAY)) AS step_start")
    rows = rows.withColumn("step_end", F.date_add("step_start", days))
    return rows.select((F.floor(F.datediff("step_start", F.lit(start)) / days)).cast("int").alias("step"), "step_start", "step_end")


def next_active(ranked: DataFrame, most: int = 0, changes: int = 0, least: int = 0) -> DataFrame:
    """(symbol, tier) of the next step's symbols from (symbol, score, pnl, trades, trades_step, was).

    Symbols with a gain so far are wanted (all, if none has one), best score first. Of ``most`` at most, all but ``changes``
    are kept from those active now. If fewer than ``least`` are in, others follow: with trades in the last step, with any,
    then the rest. Tiers: 0 kept, 1 wanted, 2 to 4 filled up.
    """
    by_score = [F.col("score").desc(), F.col("symbol")]
    none = F.max((F.col("pnl") > 0).cast("int")).over(Window.partitionBy()) == 0
    rows = ranked.withColumn("wanted", none | (F.col("pnl") > 0))
    held = F.row_number().over(Window.partitionBy(F.col("wanted") & F.col("was")).orderBy(*by_score))
    kept = F.col("wanted") & F.col("was") & (held <= max(0, most - changes)) if most and changes else F.lit(False)
    rest = F.when(F.col("trades_step") > 0, 2).when(F.col("trades") > 0, 3).otherwise(4)
    rows = rows.withColumn("tier", F.when(kept, 0).when(F.col("wanted"), 1).otherwise(rest))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("tier", *by_score)))
    wanted = F.sum((F.col("tier") <= 1).cast("int")).over(Window.partitionBy())
    room = F.least(wanted, F.lit(most)) if most else wanted
    return rows.withColumn("room", F.greatest(room, F.lit(least))).where("place <= room").select("symbol", "tier")
