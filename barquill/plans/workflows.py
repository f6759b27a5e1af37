"""Whole jobs: bars from ticks, walk-forward training and scoring, exploration with resume, selection out of sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.functions.tables import materialize
from barquill.operators import bars as B
from barquill.operators import metrics as M
from barquill.operators import sampling as D
from barquill.operators import scoring as C
from barquill.operators import select as S
from barquill.operators.boosting import Forest
from barquill.sources import cache as K
from barquill.sources import files as W
from barquill.sources import versions as V


def build_bars(ticks: DataFrame, path: str, seconds: int = 300, gap_seconds: int = 900) -> DataFrame:
    """Gap-filled bars of ticks, written by symbol; gives the index of what was written."""
    W.write_bars(B.fill_gaps(B.from_ticks(ticks, seconds), seconds, gap_seconds), path)
    return W.bar_index(W.read_bars(ticks.sparkSession, path))


def cached_bars(ticks: DataFrame, wanted: DataFrame, home: str, seconds: int = 300) -> DataFrame:
    """Bars of the ``wanted`` intervals (symbol, lo, hi), moved out to whole bars; of ticks only those of bars that ``home`` lacks are read."""
    end = F.col("hi") + F.make_dt_interval(secs=F.lit(seconds)) - F.expr("INTERVAL 1 MICROSECOND")
    whole = wanted.withColumn("lo", B.bin_start(F.col("lo"), seconds)).withColumn("hi", B.bin_start(end, seconds))
    return K.fetch(ticks.sparkSession, f"{home}/{K.key_of('bars', seconds)}", whole, lambda missing: B.from_ticks(K.inside(ticks, missing), seconds))


def publish_step(spark: SparkSession, home: str, step: int, trades: DataFrame, returns: DataFrame) -> int:
    """The reports of a step appear together: its trades, what symbols gave, symbols that gained as universe, and equity.

    ``returns`` has key, day and r. A step that is told again replaces its reports; those of other steps stay.
    """

    def reports(_: dict[str, str]) -> dict[str, DataFrame]:
        symbols = M.symbol_contribution(trades)
        tables = {"trades": trades, "symbols": symbols, "universe": symbols.where("pnl > 0").select("symbol", "pnl"), "equity": M.curve(returns)}
        return {f"{name}/step={step}": table for name, table in tables.items()}

    return V.publish(spark, home, reports)


def step_report(spark: SparkSession, home: str, name: str, version: int | None = None) -> DataFrame:
    """One kind of report of all steps of a version, with ``step``."""
    folders = {n: f for n, f in V.pinned(spark, home, version).items() if n.startswith(f"{name}/step=")}
    parts = [spark.read.parquet(f).withColumn("step", F.lit(int(n.rpartition("=")[2]))) for n, f in sorted(folders.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train_walkforward(rows: DataFrame, features: list[str], cutoffs: list[str], key: str, most: int = 2_000_000, ratio: float = 3.0, horizon_seconds: int = 0, least_symbols: int = 1, **fit) -> list[tuple[str, object]]:
    """A model for each cutoff, from what was settled before it, with classes in ratio; cutoffs with too few symbols have none.

    The rows are read once, into a pool as large as the samples of all cutoffs together.
    """
    out = []
    pool = materialize(D.bottom_pool(rows, F.col(key), cutoffs, most, ratio, horizon_seconds), "pool") if cutoffs else None
    for cutoff in cutoffs:
        data = D.from_pool(pool, cutoffs, cutoff, F.col(key), most, ratio).cache()
        if data.select("symbol").distinct().count() >= least_symbols and data.select("label").distinct().count() > 1:
            out.append((cutoff, C.train_classifier(data, features, **fit)))
        data.unpersist()
    return out


def score_walkforward(rows: DataFrame, models: list[tuple[str, object]], columns: list[str]) -> DataFrame:
    """``columns``, period_id and p_entry of the rows after the first cutoff, each by the newest model that ended before it."""
    from pyspark.ml.functions import vector_to_array

    ends = [c for c, _ in models[1:]] + [None]
    out = None
    for i, ((cutoff, model), end) in enumerate(zip(models, ends, strict=True)):
        at = lambda x: F.lit(x).cast("timestamp_ntz")
        part = rows.where(F.col("ts") > at(cutoff)) if end is None else rows.where((F.col("ts") > at(cutoff)) & (F.col("ts") <= at(end)))
        p = F.col("p") if isinstance(model, Forest) else vector_to_array("probability")[1]
        part = model.transform(part).select(*columns, F.lit(i).alias("period_id"), p.alias("p_entry"))
        out = part if out is None else out.union(part)
    return out


def explore(configs: DataFrame, path: str, evaluate: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Try what a log does not have yet and append it; called again after a break, it goes on where it stopped."""
    spark = configs.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    todo = S.unfinished(configs, spark.read.parquet(path), keys) if there else configs
    evaluate(todo).withColumn("status", F.lit("ok")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def walkforward_oos(runs: DataFrame, returns: DataFrame, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """The best setting of each step, and the equity of what each earned in the step after it, stitched.

    ``runs`` has step, id and a score; ``returns`` (id, step, day, r) what settings earned in later steps.
    """
    best = S.pick(runs, [F.col(score).desc(), F.col("id").asc()], 1, "step").select("step", "id")
    earned = returns.join(best.select((F.col("step") + 1).alias("step"), "id"), ["step", "id"])
    return best, M.stitch(earned.select("step", "day", "r"))

