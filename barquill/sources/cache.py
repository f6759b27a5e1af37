"""A cache of computed rows that knows what it covers: intervals by symbol for each configuration, asked before anything is read.

A request is answered from what is stored (a hit), or what is missing is computed, alone, and kept (a partial hit or a
miss). Rows and the intervals that they cover are published in one step, so a cache never claims what it does not hold.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.functions.tables import materialize
from barquill.sources import versions as V
from barquill.streaming.backfill import merged, minus

COVER = "symbol string, lo timestamp_ntz, hi timestamp_ntz"
#: Folders of rows that are read together before they are written as one.
PARTS = 16


def key_of(*configs) -> str:
    """A name for what rows depend on: equal settings give the same one, any other setting another."""
    plain = [dataclasses.asdict(c) if dataclasses.is_dataclass(c) else c for c in configs]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def inside(rows: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows whose time lies in an interval of their symbol, each once. Intervals must not overlap."""
    spans = intervals.select(F.col("symbol").alias("_symbol"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return rows.join(spans, (F.col("symbol") == F.col("_symbol")) & (F.col(ts) >= F.col("_lo")) & (F.col(ts) < F.col("_hi")), "left_semi")


def widened(intervals: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Intervals with so many seconds more to warm up before and to look ahead after, merged."""
    return merged(intervals.select("symbol", (F.col("lo") - F.make_dt_interval(secs=F.lit(before))).alias("lo"), (F.col("hi") + F.make_dt_interval(secs=F.lit(after))).alias("hi")))


def cover(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """(symbol, lo, hi): what is stored, an interval without rows being stored, too."""
    folders = V.pinned(spark, home, version)
    return spark.read.schema(COVER).parquet(folders["cover"]) if "cover" in folders else spark.createDataFrame([], COVER)


def usable(cover: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(symbol): symbols for which one stored interval covers the whole of lo to hi."""
    return cover.where((F.col("lo") <= lo) & (F.col("hi") >= hi)).select("symbol").distinct()


def fetch(spark: SparkSession, home: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], ts: str = "ts", strict: bool = False) -> DataFrame:
    """The rows of the ``wanted`` intervals (symbol, lo, hi), from ``home`` and from ``compute`` for what is missing there.

    ``compute`` gets missing intervals and gives rows with ``symbol`` and ``ts``; rows outside them, such as those to warm up,
    are left out, and it is not called if nothing is missing. With ``strict`` a symbol that is stored in part counts as
    missing whole, for values that depend on where a series begins: what is stored of it is replaced. Rows without symbol or
    time are in no interval. Each configuration has a home of its own (``key_of``).
    """
    wanted = materialize(merged(wanted), "wanted")

    def lacking(stored: DataFrame) -> DataFrame:
        part = minus(wanted, stored)
        if strict:
            part = wanted.join(part.select("symbol").distinct(), "symbol", "left_semi")
        return part

    def added(folders: dict[str, str]) -> dict[str, DataFrame | None]:
        stored = spark.read.schema(COVER).parquet(folders["cover"]) if "cover" in folders else spark.createDataFrame([], COVER)
        missing = materialize(lacking(stored), "missing")
        old = sorted(n for n in folders if n.startswith("rows-"))
        if missing.isEmpty():
            return {}
        rows = inside(compute(missing), missing, ts)
        if strict and old:
            stored = stored.join(missing.select("symbol").distinct(), "symbol", "left_anti")
            rows = rows.unionByName(_parts(spark, folders, old).join(missing.select("symbol").distinct(), "symbol", "left_anti"))
        elif len(old) >= PARTS:
            rows = rows.unionByName(_parts(spark, folders, old))
        else:
            old = []
        number = 1 + max((int(n.removeprefix("rows-")) for n in folders if n.startswith("rows-")), default=0)
        return {n: None for n in old} | {f"rows-{number:06d}": rows, "cover": merged(stored.unionByName(missing))}

    if not lacking(cover(spark, home)).isEmpty():
        V.publish(spark, home, added)
    folders = V.pinned(spark, home)
    names = sorted(n for n in folders if n.startswith("rows-"))
    if not names:
        return compute(wanted).limit(0)
    return inside(_parts(spark, folders, names), wanted, ts)


def _parts(spark: SparkSession, folders: dict[str, str], names: list[str]) -> DataFrame:
    return spark.read.parquet(*(folders[n] for n in names))
