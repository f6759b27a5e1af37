"""Which of many tried settings to trust: scores, ranks, neighbours, clusters and what earlier steps say."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.nearest import grouped, k_nearest
from barquill.functions.quantiles import quantiles, quantiles_by
from barquill.functions.ranks import met, numbered, percent_rank, percent_ranks  # noqa: F401
from barquill.functions.rolling import clip
from barquill.functions.tables import materialize
from barquill.operators.memory import CLUSTER_RATE, FAMILY_RATE, FAMILY_WEIGHTS, nearness


def _n(name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(float(default)))


def _excess(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


# The constants of the three scores are fixed values.
def explore_score() -> Column:
    """Return against drawdown, lowered by little activity and bad tails; 0 without a gain."""
    ret, dd, clusters = _excess(_n("ret_pct", 0)), _excess(_n("max_dd", 0)), _excess(_n("clusters", 0))
    quality = F.log1p(ret * 40.0) / F.pow(dd + 0.04, F.lit(1.15))
    activity = clip(clusters / (clusters + 20.0), 0.15, 0.95)
    tails = (1 + 12 * _excess(-_n("worst_rolling_90d", 0))) * (1 + 18 * _excess(-_n("worst_trade", 0)))
    return F.when(ret > 0, quality * activity / tails).otherwise(0.0)


def selection_score() -> Column:
    """Root of return, lowered by drawdown, long losses and few trades; 0 without a gain or over 30 % of drawdown."""
    ret, dd = _n("ret_pct", 0) * 100, _n("max_dd", 0)
    fall = F.exp(-8.0 * dd - 18.0 * _excess(dd - 0.12) - 0.55 * _excess(_n("max_neg_month_streak", 0)) - 2.25 * clip(_n("underwater_frac", 1), 0.0, 1.0) - 7.5 * _excess(-_n("worst_rolling_90d", 0)))
    support = F.least(F.lit(1.0), _n("trades", 100) / 120) * clip(_n("profit_factor", 1), 0.85, 1.25) * (0.80 + 0.20 * clip(_n("month_pos_frac", 0), 0.0, 1.0))
    return F.when((ret <= 0) | (dd > 0.30), 0.0).otherwise(F.sqrt(F.greatest(ret, F.lit(0.0))) * 9.0 * fall * support)


def survival_score() -> Column:
    """Return lowered by every kind of loss; 0 where one of them is beyond its limit."""
    ret, dd, day, five, fort, month = (_n(*x) for x in (("ret_pct", 0), ("max_dd", 1), ("worst_day", 0), ("sum5_worst_days", 0), ("worst_14d", 0), ("worst_30d", 0)))
    out = (ret <= 0) | (dd > 0.15) | (day < -0.08) | (five < -0.22) | (month < -0.15)
    fall = (
        12.0 * dd + 42.0 * _excess(dd - 0.05) + 18.0 * _excess(-day - 0.015) + 7.0 * _excess(-five - 0.06) + 10.0 * _excess(-fort - 0.04) + 7.5 * _excess(-_n("worst_rolling_90d", 0))
        + 11.0 * _excess(-month - 0.06) + 0.70 * _excess(_n("max_neg_month_streak", 0) - 1) + 2.2 * _excess(_n("underwater_frac", 1) - 0.30)
        + 0.28 * _excess(_n("total_exposure", 1) - 1) + 1.25 * _excess(_n("max_trade_exposure", 0.1) - 0.10)
    )
    support = (0.86 + 0.14 * clip(_n("month_pos_frac", 0), 0.0, 1.0)) * F.least(F.lit(1.0), _n("trades", 0) / 120) * clip(_n("profit_factor", 1), 0.90, 1.20)
    return F.when(out, 0.0).otherwise(F.log1p(_excess(ret) * 8.0) * F.exp(-fall) * support)


def viable(runs: DataFrame) -> DataFrame:
    """Settings worth comparing; if none passes, those with any score and return."""
    strict = (F.col("score") > 0) & (F.col("ret_pct") > 0) & (F.col("max_dd") > 0) & (F.col("max_dd") <= 0.35) & (F.col("trades") >= 30) & (F.col("profit_factor") >= 1.15)
    best = runs.where(strict)
    return runs.where((F.col("score") > 0) & (F.col("ret_pct") > 0)) if best.isEmpty() else best


def elite(runs: DataFrame, least: int = 40) -> DataFrame:
    """The upper quarter by score, if it has at least ``least`` rows; else all."""
    runs = materialize(runs, "viable")
    cut = quantiles(runs.select(F.when(F.isnan("score"), float("inf")).otherwise(F.col("score")).alias("score")), "score", [0.75])  # a NaN is above all
    if cut is None:
        return runs
    top = runs.where(F.col("score") >= cut[0])
    return top if top.count() >= least else runs


def scaled(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``x``: columns between their least and largest value as 0 to 1, missing ones as the median; 0.5 if all are equal."""
    found = runs.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max), ("gaps", lambda c: F.count_if(F.col(c).isNull()))))).first().asDict()
    parts = []
    for c in columns:
        lo, hi = found[f"lo_{c}"], found[f"hi_{c}"]
        if lo is None or hi <= lo:
            parts.append(F.lit(0.5))
        else:
            x = F.col(c).cast("double")
            x = F.coalesce(x, F.lit((quantiles(runs, c, [0.5]) or [float("nan")])[0])) if found[f"gaps_{c}"] else x
            parts.append((x - float(lo)) / float(hi - lo))
    return runs.withColumn("x", F.array(*parts))


def smoothed(runs: DataFrame, k: int | None = None) -> DataFrame:
    """Adds what the k nearest settings have: neighbor_mean_score, _q25_score, _score_std and neighbor_dd_median."""
    if k is None:
        k = max(12, min(36, int(runs.count() ** 0.5 * 1.5)))
    near = k_nearest(runs.select("id", "x"), k).join(runs.select(F.col("id").alias("b"), "score", "max_dd"), "b")
    near = near.groupBy(F.col("a").alias("id")).agg(
        F.avg("score").alias("neighbor_mean_score"), F.percentile("score", F.lit(0.25)).alias("neighbor_q25_score"), F.stddev_pop("score").alias("neighbor_score_std"), F.percentile("max_dd", F.lit(0.5)).alias("neighbor_dd_median")
    )
    rows = runs.join(near, "id", "left")
    other = {"neighbor_mean_score": F.col("score"), "neighbor_q25_score": F.col("score"), "neighbor_score_std": F.lit(0.0), "neighbor_dd_median": F.col("max_dd")}
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in other.items()})


# Weights of ranks in the scores of settings and clusters. A name with a minus ranks the smallest first.
LOCAL = {"score": 18, "neighbor_mean_score": 24, "neighbor_q25_score": 26, "-max_dd": 8, "profit_factor": 6, "trades": 4, "month_pos_frac": 3, "-max_neg_month_streak": 5, "-underwater_frac": 5, "worst_rolling_90d": 4, "-top1_share_pos": 3, "-avg_trades_per_cluster": 2}
LOCAL_DD = {"score": 12, "neighbor_mean_score": 18, "neighbor_q25_score": 22, "-max_dd": 16, "-neighbor_dd_median": 10, "profit_factor": 6, "trades": 5, "month_pos_frac": 3, "-max_neg_month_streak": 7, "-underwater_frac": 7, "worst_rolling_90d": 5, "-top1_share_pos": 2, "-avg_trades_per_cluster": 1}
CLUSTER = {"local_q25": 24, "local_median": 18, "raw_q25": 12, "raw_median": 8, "neighbor_q25": 12, "neighbor_mean": 8, "-dd_median": 8, "pf_median": 4, "trade_median": 3, "month_median": 2, "-streak_median": 4, "-underwater_median": 4, "roll90_median": 3, "size": 5, "-dispersion": 2}
FAMILY = {"local_q25": 20, "local_median": 16, "-dd_median": 12, "pf_median": 6, "trade_median": 5, "month_median": 3, "-streak_median": 5, "-underwater_median": 5, "roll90_median": 6, "size": 6, "-total_exposure_median": 8, "-trade_exposure_median": 4, "prudent_median": 4}


def place(name: str) -> str:
    """The column that ``with_places`` has the percent ranks of a name in."""
    return f"_{'down' if name.startswith('-') else 'up'}_{name.lstrip('-')}"


def with_places(rows: DataFrame, names: Iterable[str], *within: str) -> DataFrame:
    """Adds a column of percent ranks for each name, those with a minus from the top, among rows of the same ``within``."""
    return percent_ranks(rows, {place(name): (name.lstrip("-"), not name.startswith("-")) for name in dict.fromkeys(names)}, list(within))


def without_places(rows: DataFrame) -> DataFrame:
    return rows.drop(*(c for c in rows.columns if c.startswith(("_up_", "_down_"))))


def ranked(weights: dict[str, int]) -> Column:
    """A sum of percent ranks that ``with_places`` has added, weighted in hundredths."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.col(place(name)) * (weight / 100)
    return out


def local_scores(runs: DataFrame) -> DataFrame:
    """Adds local_robust_score, local_dd_score and prudent_variant_score to runs with neighbours."""
    rows = with_places(runs, [*LOCAL, *LOCAL_DD, "-neighbor_score_std", "-neighbor_dd_median", "-total_exposure", "-max_trade_exposure", "-max_dd"])
    std, dd = F.col(place("-neighbor_score_std")), F.col(place("-neighbor_dd_median"))
    rows = rows.withColumn("local_robust_score", ranked(LOCAL) * (0.85 + 0.15 * std) * (0.85 + 0.15 * dd)).withColumn("local_dd_score", ranked(LOCAL_DD) * (0.82 + 0.18 * std))
    exposure = F.col(place("-total_exposure")) * 0.22 + F.col(place("-max_trade_exposure")) * 0.12 + F.col(place("-max_dd")) * 0.08
    return without_places(rows.withColumn("prudent_variant_score", F.col("local_dd_score") * 0.40 + F.col("local_robust_score") * 0.18 + exposure))


def cluster_radius(runs: DataFrame, floor: float = 0.55) -> float:
    """1.15 times the median distance of the k-th nearest setting, k from 2 to 8, and ``floor`` at least."""
    n = runs.count()
    if n < 2:
        return 0.0
    k = max(2, min(8, n - 1))
    kth = materialize(k_nearest(runs.select("id", "x"), min(k, n - 1)).where(F.col("rank") == min(k, n - 1)).select("distance"), "kth")
    return max(floor, (quantiles(kth, "distance", [0.5]) or [0.0])[0] * 1.15)


def clustered(runs: DataFrame, radius: float) -> DataFrame:
    """Adds cluster_id: numbers of the groups of settings that steps of at most ``radius`` connect, by smallest id."""
    rows = runs.join(grouped(runs.select("id", "x"), radius), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return numbered(rows, "component", "cluster_id").drop("component")


def centres(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, center): the median of each part of ``x``."""
    each = quantiles_by(runs.select(*keys, F.posexplode("x").alias("i", "v")), [*keys, "i"], {"q": ("v", [0.5])}).select(*keys, "i", F.col("q")[0].alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("center"))


def apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def cluster_stats(runs: DataFrame) -> DataFrame:
    """One row for each cluster: sizes, medians, lower quartiles, dispersion and cluster_score; ``center`` comes along."""
    runs = materialize(runs, "runs")
    middle = materialize(centres(runs, "cluster_id"), "centres")
    rows = runs.join(middle, "cluster_id").withColumn("center_dist", apart(F.col("x"), F.col("center")))
    halves = {
        "local_median": "local_robust_score", "raw_median": "score", "dd_median": "max_dd", "pf_median": "profit_factor", "trade_median": "trades", "month_median": "month_pos_frac",
        "streak_median": "max_neg_month_streak", "underwater_median": "underwater_frac", "roll90_median": "worst_rolling_90d", "neighbor_mean": "neighbor_mean_score", "neighbor_q25": "neighbor_q25_score", "dispersion": "center_dist",
    }
    quarters = {"local_q25": "local_robust_score", "raw_q25": "score"}
    stats = _middles(rows, "cluster_id", halves, quarters).join(rows.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    return without_places(with_places(stats, CLUSTER).withColumn("cluster_score", ranked(CLUSTER))).join(middle, "cluster_id")


def continuity(clusters: DataFrame, memory: DataFrame, step: float, step_days: float = 180.0, rate: float = CLUSTER_RATE, limit: int = 24) -> DataFrame:
    """Adds causal_continuity and causal_coverage_steps: how near clusters are to what earlier steps chose.

    ``memory`` (step, center, quality) has a few rows for each of the last steps; the newest ``limit`` rows count. Nearness falls with distance and with steps
    between; the mean of the four nearest counts, and how many steps have one nearer than 0.55.
    """
    held = memory.select("step", "center", "quality").orderBy(F.col("step").desc(), F.col("quality").desc()).limit(limit).collect()
    near, seen = nearness(F.col("center"), F.lit(float(step)), held, rate, step_days)
    return clusters.withColumn("causal_continuity", near).withColumn("causal_coverage_steps", seen)


def causal_score(clusters: DataFrame) -> DataFrame:
    rows = with_places(clusters, ["causal_continuity", "causal_coverage_steps"])
    return without_places(rows.withColumn("causal_cluster_score", F.col("cluster_score") * 0.72 + F.col(place("causal_continuity")) * 0.20 + F.col(place("causal_coverage_steps")) * 0.08))


def family_key(columns: list[tuple[str, str]]) -> Column:
    """A text that settings of one family share: name=value with six decimals."""
    return F.concat_ws("|", *(F.format_string(f"{short}=%.6f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for short, c in columns))


def _middles(runs: DataFrame, key: str | list[str], halves: dict[str, str], quarters: dict[str, str]) -> DataFrame:
    """By key the medians and lower quartiles of columns, exact, without a key's values in one place."""
    wanted = {c: (c, [0.25, 0.5]) for c in dict.fromkeys([*halves.values(), *quarters.values()])}
    keys = [key] if isinstance(key, str) else key
    found = quantiles_by(runs, keys, wanted)
    return found.select(*keys, *(F.col(c)[1].alias(name) for name, c in halves.items()), *(F.col(c)[0].alias(name) for name, c in quarters.items()))


def family_stats(runs: DataFrame) -> DataFrame:
    middles = _middles(runs, "family_key", {"family_score_median": "score", "family_dd_median": "max_dd"}, {"family_score_q25": "score"})
    counts = runs.groupBy("family_key").agg(F.count("*").alias("family_size"), F.max("score").alias("family_score_max"))
    middles = middles.withColumnRenamed("family_key", "_key")
    return counts.join(middles, F.col("family_key").eqNullSafe(F.col("_key"))).drop("_key")


def family_scores(runs: DataFrame, *within: str) -> DataFrame:
    """Families with their size, medians, lower quartile of the local score and family_score, all among those of the same ``within``.

    Medians count to twelve places, so that ties are ties whatever the order of sums.
    """
    keys = [*within, "family_key"]
    halves = {
        "local_median": "local_robust_score", "dd_median": "max_dd", "pf_median": "profit_factor", "trade_median": "trades", "month_median": "month_pos_frac", "streak_median": "max_neg_month_streak", "underwater_median": "underwater_frac",
        "roll90_median": "worst_rolling_90d", "total_exposure_median": "total_exposure", "trade_exposure_median": "max_trade_exposure", "prudent_median": "prudent_variant_score",
    }
    stats = _middles(runs, keys, halves, {"local_q25": "local_robust_score"})
    stats = stats.withColumns({c: F.round(c, 12) for c in stats.columns if c not in keys})
    stats = materialize(met(stats, runs.groupBy(*keys).agg(F.count("*").alias("size")), keys), "families")
    return with_places(stats, FAMILY, *within).withColumn("family_score", ranked(FAMILY)).select(*stats.columns, "family_score")


def pick(runs: DataFrame, order: list[Column], n: int = 1, key: str | None = None) -> DataFrame:
    """The first n rows in an order of several keys, of each ``key`` if one is given."""
    if key is None:
        return runs.orderBy(*order).limit(n)
    return runs.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def enriched(runs: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Runs with the metrics that they lack."""
    names = [c for c in metrics.columns if c != key]
    other = metrics.select(key, *(F.col(c).alias(f"_m_{c}") for c in names))
    rows = runs.join(other, key, "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) if c in runs.columns else F.col(f"_m_{c}") for c in names}).drop(*(f"_m_{c}" for c in names))


def lineage(log: DataFrame) -> DataFrame:
    """Each ok backtest with the last ok training and label refresh that it comes from."""
    ok = log.where("status = 'ok'")
    last = lambda stage, key: ok.where(F.col("stage") == stage).groupBy(key).agg(F.max_by(F.struct(*log.columns), "ts").alias(stage))
    return ok.where("stage = 'backtest'").join(last("train", "model_id"), "model_id", "left").join(last("refresh", "label_id"), "label_id", "left")


def progress(log: DataFrame) -> DataFrame:
    """By step: the largest number at the end of backtest ids, and ok rows and different ids of each stage."""
    ok = F.col("status") == "ok"
    number = F.regexp_extract("backtest_id", r"(\d+)$", 1)
    return log.groupBy("step").agg(
        F.max(F.when(number != "", number.cast("long"))).alias("last_number"), F.count_if(ok & (F.col("stage") == "train")).alias("trained"), F.count_if(ok & (F.col("stage") == "backtest")).alias("tested"),
        F.count_distinct(F.when(ok, F.col("model_id"))).alias("models"), F.count_distinct(F.when(ok, F.col("backtest_id"))).alias("backtests"),
    )


def unfinished(configs: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Settings that have not been tried with success."""
    return configs.join(log.where("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


# How each way of selecting blends scores, in hundredths, and what it sorts by, all from the top.
MODES: dict[str, tuple[dict[str, int], list[str]]] = {
    "causal_cluster": ({"causal_cluster_score": 62, "local_dd_score": 23, "local_robust_score": 10, "cluster_center_rank": 5}, ["causal_cluster_score", "robust_score", "cluster_score", "cluster_center_rank", "neighbor_q25_score", "score"]),
    "cluster_blend": ({"cluster_score": 55, "local_dd_score": 30, "local_robust_score": 10, "cluster_center_rank": 5}, ["cluster_score", "robust_score", "local_q25", "size", "cluster_center_rank", "score"]),
    "family_causal": ({"family_causal_score": 58, "prudent_variant_score": 24, "local_dd_score": 10, "local_robust_score": 8}, ["family_causal_score", "prudent_variant_score", "robust_score", "family_center_rank", "score"]),
    "local": ({"local_robust_score": 100}, ["robust_score", "neighbor_q25_score", "neighbor_mean_score", "score"]),
    "local_dd": ({"local_dd_score": 100}, ["robust_score", "dd_rank", "neighbor_q25_score", "neighbor_mean_score", "score"]),
}


def selected(candidates: DataFrame, mode: str, n: int = 1) -> DataFrame:
    """The n best candidates by one of ``MODES``; ties to the smaller id. cluster_filter guards the local score by cluster."""
    if mode == "cluster_filter":
        half = lambda c: F.lit((quantiles(candidates, c, [0.5]) or [None])[0])
        guard = (F.col("size") >= 2).cast("double") * 0.5 + (F.col("local_q25") >= half("local_q25")).cast("double") * 0.3 + (F.col("dd_median") <= half("dd_median")).cast("double") * 0.2
        rows = candidates.withColumn("cluster_guard", guard).withColumn("robust_score", F.col("local_dd_score") * (0.92 + 0.12 * F.col("cluster_guard")))
        order = ["cluster_guard", "robust_score", "size", "neighbor_q25_score", "score"]
    else:
        blend, order = MODES[mode]
        score = F.lit(0.0)
        for name, weight in blend.items():
            score = score + F.coalesce(F.col(name), F.lit(0.0)) * (weight / 100)
        rows = candidates if "dd_rank" in candidates.columns else percent_ranks(candidates, {"dd_rank": ("max_dd", False)})
        rows = rows.withColumn("robust_score", score)
    return pick(rows, [*(F.col(c).desc_nulls_last() for c in order), F.col("id").asc()], n)


def candidates(runs: DataFrame, columns: list[str], memory: DataFrame, step: float, floor: float = 0.55) -> DataFrame:
    """Viable settings with every score: neighbours, clusters, families, and nearness to what earlier steps chose."""
    rows = materialize(scaled(elite(viable(runs)), columns), "runs")
    rows = materialize(local_scores(smoothed(rows)), "runs")
    rows = clustered(rows, cluster_radius(rows, floor))
    clusters = causal_score(continuity(cluster_stats(rows), memory, step))
    rows = rows.join(clusters, "cluster_id").withColumn("center_dist", apart(F.col("x"), F.col("center"))).drop("center")
    rows = materialize(percent_ranks(rows, {"cluster_center_rank": ("center_dist", False)}), "runs")
    families = family_scores(rows).select("family_key", F.col("size").alias("family_size"), "family_score").join(centres(rows, "family_key"), "family_key")
    own, near, seen = FAMILY_WEIGHTS
    families = with_places(continuity(families, memory, step, rate=FAMILY_RATE), ["causal_continuity", "causal_coverage_steps"])
    score = F.col("family_score") * own + F.col(place("causal_continuity")) * near + F.col(place("causal_coverage_steps")) * seen
    families = families.select("family_key", "center", "family_size", score.alias("family_causal_score"))
    rows = rows.join(families, "family_key").withColumn("family_dist", apart(F.col("x"), F.col("center"))).drop("center")
    return percent_ranks(rows, {"family_center_rank": ("family_dist", False), "dd_rank": ("max_dd", False)})


def remembered(clusters: DataFrame, step: float, n: int = 3) -> DataFrame:
    """(step, center, quality) of the best n clusters of a step, to be remembered by later ones."""
    top = clusters.orderBy(F.col("causal_cluster_score").desc(), "cluster_id").limit(n)
    return top.select(F.lit(float(step)).alias("step"), "center", F.col("causal_cluster_score").alias("quality"))


def step_summary(log: DataFrame) -> DataFrame:
    """One row for each step of a scored run log: the best backtest's score, return, drawdown and win rate, and counts of phases.

    Only backtests that went well count; missing and non-finite numbers are 0, a missing phase is broad, a missing
    generation the first. Of equal scores the smaller id is best.
    """
    known = lambda c: F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)), F.lit(0.0))
    rows = log.where("stage = 'backtest' AND status = 'ok'")
    first = F.max_by(F.struct(*(known(c).alias(c) for c in ("score", "ret_pct", "max_dd", "win_rate"))), F.struct(known("score"), -F.col("id")))
    phase = F.coalesce("phase", F.lit("broad"))
    rows = rows.groupBy("step").agg(first.alias("b"), F.count("*").alias("total_ok"), F.count_if(phase == "broad").alias("broad_ok"), F.count_if(phase == "refine").alias("refine_ok"), F.max(F.coalesce("generation", F.lit(1))).alias("latest_generation"))
    share = lambda c: F.round(F.col(f"b.{c}") * 100, 1)
    return rows.select("step", F.round("b.score", 2).alias("best_score"), share("ret_pct").alias("best_ret"), share("max_dd").alias("best_dd"), share("win_rate").alias("best_wr"), "total_ok", "broad_ok", "refine_ok", "latest_generation")


def top_runs(log: DataFrame, n: int = 100) -> DataFrame:
    """The n best backtests of each step."""
    return pick(log.where("stage = 'backtest' AND status = 'ok'"), [F.col("score").desc_nulls_last(), F.col("id")], n, "step")


def selected_rows(segments: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """For each segment the first row of the log (by ``line``) with its step and ids; segments that lack one of them have none."""
    whole = segments.na.drop(subset=["source_step", *keys])
    first = log.groupBy("step", *keys).agg(F.min_by(F.struct(*[c for c in log.columns if c not in ("step", *keys)]), "line").alias("_row"))
    found = whole.join(first.withColumnRenamed("step", "source_step"), ["source_step", *keys])
    return found.select(*whole.columns, "_row.*")
