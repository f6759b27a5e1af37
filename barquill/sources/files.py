"""Tables in files: bars by symbol, run logs, equity curves, text lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet by symbol, which scans for some symbols then read alone."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").partitionBy("symbol").parquet(path)


def replace_symbols(bars: DataFrame, path: str) -> None:
    """Replace the symbols in ``bars`` and leave the others."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("symbol").isin(symbols)) if symbols else rows
    return rows.select([c for c in columns if c in rows.columns]) if columns else rows


def bar_index(bars: DataFrame) -> DataFrame:
    """(symbol, rows, first, last): what is in a table of bars."""
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def read_log(spark: SparkSession, path: str, only_ok: bool = True) -> DataFrame:
    """A run log in CSV, every column as text; backtests that went well, or all rows."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where((F.col("stage") == "backtest") & (F.col("status") == "ok")) if only_ok else rows


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text as numbers, null where it is none."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_equity(spark: SparkSession, path: str) -> DataFrame:
    """(day, equity) from CSV: the first column is a date, the value in ``equity`` or else the second."""
    rows = spark.read.option("header", True).csv(path)
    value = "equity" if "equity" in rows.columns else rows.columns[1]
    return rows.select(F.to_date(F.col(rows.columns[0]).substr(1, 10)).alias("day"), F.col(value).try_cast("double").alias("equity")).na.drop()


def log_tail(spark: SparkSession, path: str, n: int = 300, stamp: str = "ts_utc") -> DataFrame:
    """(line, record): the last n lines of a log of JSON objects that are whole and have a time, in order of their lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("record"))
    sound = F.try_variant_get(F.try_parse_json("record"), f"$.{stamp}", "string").isNotNull() & F.col("record").startswith("{")
    return lines.where(sound).orderBy(F.col("line").desc()).limit(max(0, n))


def refresh_labels(features: DataFrame, labels: DataFrame, prefix: str = "sniper_") -> DataFrame:
    """Features with new labels: old label columns go, those of ``labels`` come in by symbol and time."""
    old = [c for c in features.columns if c.startswith(prefix) or (c in labels.columns and c not in ("symbol", "ts"))]
    return features.drop(*old).join(labels, ["symbol", "ts"], "left")


def thinned(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Every k-th row of each key, so that about ``most`` are left to draw."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / most)))
    return rows.where((F.col("_n") - 1) % F.col("_k") == 0).drop("_n", "_k")


def stock_symbol(name):
    """A stock's symbol as file names have it: upper case, dots as dashes."""
    return F.regexp_replace(F.upper(name), r"\.", "-")
