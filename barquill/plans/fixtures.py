"""The roles that the driver's tables play, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol is the type, price the value."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("tick_id"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_ticks(ticks(spark, sf_dir), 3600)


BARS = """bars AS (
  SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts, first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high,
    min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close, count(*)::DOUBLE AS volume
  FROM events e GROUP BY e.event_type, date_trunc('hour', e.ts)
)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades of 16 symbols: r_net, weight, exit and entry times."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 16).cast("string")).alias("symbol"), F.col("l_shipdate").alias("exit_ts"),
        F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("r_net"), (F.col("l_quantity") / 500).alias("weight"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


TRADES = """trades AS (
  SELECT 'S' || (l_suppkey % 16)::VARCHAR AS symbol, l_shipdate AS exit_ts, round(l_discount - l_tax, 4) AS r_net, l_quantity / 500 AS weight,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily equity curve from orders: the day's mean price against the mean of all, a hundredth of it as a return."""
    orders = table(spark, sf_dir, "orders")
    overall = orders.agg(F.avg("o_totalprice").alias("m")).first().m
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round((F.avg("o_totalprice") / F.lit(overall) - 1) / 100, 6).alias("r"))


DAILY = """daily AS (
  SELECT o_orderdate::DATE AS day, round((avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) - 1) / 100, 6) AS r FROM orders GROUP BY 1
)"""
