"""Price bars: made from ticks, put on a grid, filled, cut into segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row for each key, the last to arrive. A maximum by key, so repeats are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("row"))
    return last.select(*(F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns))


def keep_first(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("row"))
    return first.select(*(F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns))


def scan(df: DataFrame, start: str | None = None, end: str | None = None, tail_days: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Rows with start <= ts < end, without the last ``tail_days`` days of each symbol; bounds and columns reach the scan.

    Of ``columns`` those that exist are read.
    """
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    if columns:
        df = df.select([c for c in columns if c in df.columns])
    if tail_days:
        last = df.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
        cut = F.col("last_ts") - F.make_dt_interval(F.lit(tail_days))
        df = df.join(last, "symbol").where(F.col("ts") < cut).drop("last_ts")
    return df


def bin_start(ts: Column, seconds: int) -> Column:
    """The start of the bin that a time is in; bins are closed on the left and named by it."""
    return F.window(ts, f"{seconds} seconds")["start"].cast("timestamp_ntz")


def from_ticks(ticks: DataFrame, seconds: int = 3600) -> DataFrame:
    """Bars from (symbol, ts, price, qty, tick_id); ticks at one time are in order of tick_id. Bins without ticks give none."""
    at = F.struct("ts", "tick_id")
    return ticks.groupBy("symbol", bin_start(F.col("ts"), seconds).alias("bin")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume")
    ).withColumnRenamed("bin", "ts")


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Longer bars from shorter ones; gap_after is false."""
    return bars.groupBy("symbol", bin_start(F.col("ts"), seconds).alias("bin")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bin", "ts").withColumn("gap_after", F.lit(False))


def grid(bars: DataFrame, seconds: int) -> DataFrame:
    """Every bin from a symbol's first bar to its last; new ones are null."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    bins = ends.select("symbol", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("ts"))
    return bins.join(bars, ["symbol", "ts"], "left")


def fill_gaps(bars: DataFrame, seconds: int, most_seconds: int = 900) -> DataFrame:
    """Bars on a grid. Close is carried forward; a gap of at most ``most_seconds`` gets flat bars without volume at it.

    Longer gaps keep open, high and low null, and the bar before one has gap_after. Also given: ``missing``.
    """
    by = Window.partitionBy("symbol").orderBy("ts")
    rows = grid(bars, seconds).withColumn("missing", F.col("close").isNull())
    rows = rows.withColumn("changed", F.coalesce((F.col("missing") != F.lag("missing").over(by)).cast("int"), F.lit(1)))
    rows = rows.withColumn("stretch", F.sum("changed").over(by))
    rows = rows.withColumn("close", F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("gap_rows", F.count("*").over(Window.partitionBy("symbol", "stretch")))
    rows = rows.withColumn("long_gap", F.col("missing") & (F.col("gap_rows") > most_seconds // seconds))
    flat = F.col("missing") & ~F.col("long_gap")
    for c in ("open", "high", "low"):
        rows = rows.withColumn(c, F.when(flat, F.col("close")).otherwise(F.col(c)))
    rows = rows.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    rows = rows.withColumn("gap_after", ~F.col("missing") & F.coalesce(F.lead("long_gap").over(by), F.lit(False)))
    return rows.select("symbol", "ts", "open", "high", "low", "close", "volume", "missing", "gap_after")


def segments(bars: DataFrame) -> DataFrame:
    """``seg`` and ``rn``: numbers of the stretch of bars with all prices, and of the row in it; other bars are left out."""
    by = Window.partitionBy("symbol").orderBy("ts")
    sound = F.lit(True)
    for c in ("open", "high", "low", "close"):
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c)
    rows = bars.withColumn("sound", sound).withColumn("turn", (F.col("sound") != F.lag("sound", 1, False).over(by)).cast("int"))
    rows = rows.withColumn("seg", F.sum("turn").over(by)).where("sound").drop("sound", "turn")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("symbol", "seg").orderBy("ts")))


def frozen(bars: DataFrame) -> DataFrame:
    """Adds ``frozen``: whether all prices are those of the bar before."""
    by = Window.partitionBy("symbol").orderBy("ts")
    same = F.lit(True)
    for c in ("open", "high", "low", "close"):
        same = same & F.coalesce(F.col(c) == F.lag(c).over(by), F.lit(False))
    return bars.withColumn("frozen", same)


def stride(bars: DataFrame, k: int) -> DataFrame:
    """Every k-th row of a symbol, the first included."""
    return bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).where((F.col("n") - 1) % k == 0).drop("n")


def next_gap(bars: DataFrame, hours: float) -> DataFrame:
    """Adds ``gap_in``: how many rows on the first bar is that comes at least ``hours`` after the one before it."""
    by = Window.partitionBy("symbol").orderBy("ts")
    late = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(by).cast("timestamp")) >= hours * 3600
    rows = bars.withColumn("n", F.row_number().over(by)).withColumn("late", F.coalesce(late, F.lit(False)))
    found = F.min(F.when(F.col("late"), F.col("n"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("gap_in", found - F.col("n")).drop("n", "late")


def candle_seconds(bars: DataFrame) -> DataFrame:
    """(symbol, candle_seconds): the least step between bars of each symbol."""
    by = Window.partitionBy("symbol").orderBy("ts")
    step = F.unix_timestamp(F.lead("ts").over(by).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return bars.withColumn("step", step).groupBy("symbol").agg(F.min("step").alias("candle_seconds"))


def coverage(bars: DataFrame, seconds: int, start: str, end: str, use: int = 900, skip: int = 500) -> DataFrame:
    """How many rows of each symbol a period would give: its slots in the period times the density of its rows.

    ``decision`` is use, skip or load (in between).
    """
    second = lambda c: F.unix_timestamp(c.cast("timestamp"))
    each = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    slots = (second(F.col("hi")) - second(F.col("lo"))) / seconds + 1
    at = lambda x: second(F.lit(x).cast("timestamp_ntz"))
    overlap = F.greatest(F.lit(0.0), (F.least(second(F.col("hi")), at(end)) - F.greatest(second(F.col("lo")), at(start))) / seconds + 1)
    rows = each.withColumn("rows", overlap * F.col("n") / slots)
    return rows.select("symbol", "n", F.round("rows", 6).alias("rows"), F.when(F.col("rows") >= use, "use").when(F.col("rows") < skip, "skip").otherwise("load").alias("decision"))


def bars_of_minutes(minutes: float, candle: int) -> int:
    """Rows that a time in minutes takes; one at least."""
    return max(1, round(minutes * 60 / candle))


def timeframe(seconds: int) -> str:
    """5m, 1h, 1d or 45s."""
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"
