"""Models over time: which one scores a row, how scores are calibrated, how good the best scores are."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.quantiles import quantiles
from barquill.functions.rolling import clip


def as_of(rows: DataFrame, periods: DataFrame, ts: str = "ts", start: str = "train_end") -> DataFrame:
    """Each row with the newest period that ended strictly before it, null before the first, without periods or without a time.

    Periods become the ranges between their ends, and ranges the days that they touch, so that the join is by equal days
    and Spark may shuffle or broadcast as sizes ask for; the open range after the last end is a day of its own. Periods
    without an end are left out; of periods with equal ends one counts.
    """
    kind = periods.schema[start].dataType
    ranges = periods.where(F.col(start).isNotNull()).withColumn("_to", F.lead(start).over(Window.orderBy(start)))
    last = F.lit(periods.agg(F.max(start).cast("string").alias("last")).first().last).cast(kind)
    after = F.to_date(F.lit("9999-12-31"))
    days = F.when(F.col("_to").isNull(), F.array(after)).otherwise(F.sequence(F.to_date(start), F.to_date("_to")))
    ranges = ranges.withColumn("_day", F.explode(days))
    timed = rows.withColumn("_row_day", F.when(F.col(ts) > last, after).otherwise(F.to_date(ts)))
    within = (F.col(ts) > F.col(start)) & (F.col("_to").isNull() | (F.col(ts) <= F.col("_to")))
    return timed.join(ranges, (F.col("_row_day") == F.col("_day")) & within, "left").drop("_to", "_day", "_row_day")


def last_before(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before its time, by key.

    Both sides are put in one order by time and the last values carried forward, so there is one shuffle by key and
    neither side has to be small.
    """
    r = right.select(key, F.col(ts), F.lit(1 if strict else 0).alias("_side"), F.struct(*values).alias("_v"), *(F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (key, ts)))
    x = left.select(key, F.col(ts), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *(F.col(c) for c in left.columns if c not in (key, ts)))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(x).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where(F.col("_side") == (0 if strict else 1)).select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Straight lines between knots, level beyond them."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        at = ys[i - 1] + (x - xs[i - 1]) * ((ys[i] - ys[i - 1]) / max(xs[i] - xs[i - 1], 1e-12))
        out = F.when(x <= xs[i], at).otherwise(out)
    return F.when(x.isNull(), None).when(x <= xs[0], float(ys[0])).otherwise(out)


@dataclass(frozen=True)
class Calibration:
    kind: str = "identity"  # identity, isotonic, platt
    coef: float = 1.0
    intercept: float = 0.0
    prior_shift: float = 0.0
    logits: bool = True
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()
    tail_blend: float = 0.0
    tail_start: float = 0.8
    tail_power: float = 1.0
    tail_boost: float = 0.0


def calibrated(p: Column, c: Calibration) -> Column:
    """A score made a probability; above ``tail_start`` it is drawn back to the raw score and lifted. Within 0 and 1."""
    if c.kind == "isotonic":
        out = interpolated(p, list(c.xs), list(c.ys))
    elif c.kind == "platt":
        out = sigmoid(c.coef * (logit(p) if c.logits else p) + c.intercept + c.prior_shift)
    else:
        out = p
    if c.tail_blend > 0 or c.tail_boost > 0:
        depth = F.pow(clip((p - c.tail_start) / max(1e-9, 1 - c.tail_start), 0.0, 1.0), F.lit(c.tail_power))
        out = out + c.tail_blend * depth * (p - out) + c.tail_boost * depth * (1 - out)
    return clip(out, 0.0, 1.0)


def merged_sides(long: Column, short: Column) -> Column:
    """The larger of two sides' scores; a side that is missing or not a number does not count."""
    known = lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.greatest(known(long), known(short))


def sound(x: Column) -> Column:
    """Missing and non-finite values as 0, for scoring."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), x).otherwise(0.0)


def threshold_for_adding(tau: float) -> float:
    return min(0.99, max(0.01, 1.1 * tau))


def precision_at(df: DataFrame, score: str, label: str, key: str, fractions: list[float], least: int = 1) -> DataFrame:
    """(fraction, k, precision): the share of positives among the k = max(least, round(fraction * n)) best scores in [0, 1].

    Ranks are counts of better steps of the score plus a rank inside the step, made once for all fractions.
    """
    rows = df.select(F.col(score).alias("_s"), F.col(label).alias("_y"), F.col(key).alias("_id"), (-F.floor(F.col(score) * 4096)).alias("_step"))
    counts = rows.groupBy("_step").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col("_step").alias("_of"), (F.sum("_n").over(Window.orderBy("_step")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_step").orderBy(F.col("_s").desc(), "_id"))
    rows = rows.withColumn("_rank", inside).join(counts, F.col("_step").eqNullSafe(F.col("_of"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    n = df.count()
    ks = [min(n, max(least, int(round(q * n)))) for q in fractions]
    found = rows.agg(*(F.avg(F.when(F.col("_rank") <= k, F.col("_y"))).alias(f"p{i}") for i, k in enumerate(ks)))
    each = (F.struct(F.lit(q).alias("fraction"), F.lit(k).cast("long").alias("k"), F.col(f"p{i}").alias("precision")) for i, (q, k) in enumerate(zip(fractions, ks, strict=True)))
    return found.select(F.inline(F.array(*each)))


def clip_to_quantiles(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    q = quantiles(df, column, [low, high])
    return df.withColumn(column, clip(F.col(column), q[0], q[1])) if q else df


def train_classifier(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, depth: int = 5, rounds: int = 20):
    """Boosted trees on rows with all features; a fitted pipeline whose ``transform`` adds probability."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=depth, maxIter=rounds, seed=1, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), trees]).fit(df)


def train_regressor(df: DataFrame, features: list[str], target: str, depth: int = 5, rounds: int = 20):
    """Boosted trees on the logarithm of one plus the target."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(featuresCol="features", labelCol="log_target", maxDepth=depth, maxIter=rounds, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), trees]).fit(df.withColumn("log_target", F.log1p(target)))


def prior_shift(sampled: float, natural: float) -> float:
    """What to add to a logit that was fitted on a sample with another share of positives than nature's."""
    odds = lambda p: min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p)))
    return math.log(odds(natural) / odds(sampled))


def fit_platt(df: DataFrame, score: str, label: str, shrink: float = 10.0, natural_rate: float | None = None) -> Calibration:
    """A logistic curve on the logit of a score, moved to ``natural_rate`` if the rows are a sample with another share of positives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["_logit"], outputCol="features").transform(df.withColumn("_logit", logit(F.col(score))))
    model = LogisticRegression(labelCol=label, regParam=shrink / max(1, df.count())).fit(rows)
    sampled = df.agg(F.avg(F.col(label).cast("double"))).first()[0] if natural_rate is not None else None
    shift = prior_shift(sampled, natural_rate) if sampled is not None else 0.0
    return Calibration("platt", prior_shift=shift, coef=min(10.0, max(0.05, float(model.coefficients[0]))), intercept=min(10.0, max(-10.0, float(model.intercept))))


def fit_isotonic(df: DataFrame, score: str, label: str, knots: int = 128) -> Calibration:
    """A rising step curve, thinned to at most ``knots`` knots."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(df.select(score, F.col(label).cast("double")))
    xs, ys = [float(x) for x in model.boundaries], [float(y) for y in model.predictions]
    if len(xs) > knots:
        keep = sorted({round(i * (len(xs) - 1) / (knots - 1)) for i in range(knots)})
        xs, ys = [xs[i] for i in keep], [ys[i] for i in keep]
    return Calibration("isotonic", xs=tuple(xs), ys=tuple(ys))
