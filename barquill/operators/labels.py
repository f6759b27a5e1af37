"""Labels that look ahead: what a trade entered at a bar would have come to.

Horizons are cut at the end of a symbol's bars. Walks over the bars ahead are folds of arrays of at most the horizon's
length, inside Spark's own expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barquill.functions.rolling import clip, ratio


def by() -> WindowSpec:
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("ts")


# Thresholds, scales and gains of entry labels and their weights, of exit spans and of future-mean labels.
@dataclass(frozen=True)
class LabelConfig:
    horizon: int = 48  # bars
    future: int = 12
    early: int = 3
    cost: float = 0.0  # of both sides
    exit_span: int = 12  # bars; 0: no exit before the horizon
    exit_offset: float = 0.0
    profit: float = 0.03
    profit_only: bool = False
    no_dip: bool = False
    neutral: bool = True
    mean: float = 0.0018
    early_mean: float = 0.0008
    early_worst: float = -1.0
    risk: float = 0.0008
    end: float = 0.0030
    efficiency: float = 0.13
    positive: float = 0.60
    consistency: float = 0.0038
    mae: float = -0.011
    neg_profit: float = 0.0040
    neg_mean: float = 0.0008
    neg_early_mean: float = 0.0002
    neg_early_worst: float = -0.0060
    neg_risk: float = 0.0
    neg_end: float = 0.0010
    neg_efficiency: float = 0.08
    neg_positive: float = 0.50
    neg_consistency: float = 0.0015
    neg_mae: float = -0.012
    neg_failures: int = 3
    drawdown_penalty: float = 1.5
    mean_cap: float = 0.03
    early_cap: float = 0.01
    end_cap: float = 0.04
    early_gain: float = 0.0
    end_gain: float = 0.0
    efficiency_gain: float = 0.0
    positive_gain: float = 0.0
    early_penalty: float = 0.0
    weight: str = "return"  # return, size, mean, directed, risk or consistency
    weight_max: float = 7.0
    weight_power: float = 1.35
    deadzone: float = 0.002
    scale_pos: float = 0.04
    scale_neg: float = 0.03
    gain_pos: float = 6.0
    gain_neg: float = 5.0
    power_pos: float = 2.6
    power_neg: float = 2.2
    pos_scale: float = 1.0
    neg_scale: float = 1.0
    zero: bool = False  # whether 0 is a price like any other, and not a missing one


def _after(x: Column, first: int, last: int, what=F.avg) -> Column:
    return what(x).over(by().rowsBetween(first, last))


def walk(cfg: LabelConfig) -> Column:
    """The exit of a trade: bars held (0: to the horizon), price, worst price and deepest fall from entry.

    An exponential average starts at the entry price less an offset, takes in each close and ends the trade at the
    first close below it.
    """
    alpha = 2.0 / (cfg.exit_span + 1.0)
    low = F.col("low") if cfg.zero else F.when(F.col("low") > 0, F.col("low"))
    ahead = F.collect_list(F.struct("close", F.coalesce(low, F.col("close")).alias("low"))).over(by().rowsBetween(1, cfg.horizon))
    start = F.struct(
        (F.col("close") * (1 - cfg.exit_offset)).alias("ema"), F.lit(0).alias("k"), F.lit(0).alias("out"), F.col("close").alias("price"), F.col("close").alias("worst")
    )

    def step(acc: Column, x: Column) -> Column:
        ema = acc["ema"] + alpha * (x["close"] - acc["ema"])
        leaves = (x["close"] < ema) if cfg.exit_span > 0 else F.lit(False)
        new = F.struct(
            ema.alias("ema"), (acc["k"] + 1).alias("k"), F.when(leaves, acc["k"] + 1).otherwise(0).alias("out"), x["close"].alias("price"), F.least(acc["worst"], x["low"]).alias("worst")
        )
        return F.when(acc["out"] > 0, acc).otherwise(new)

    return F.aggregate(ahead, start, step)


def _saturated(x: Column, cap: float) -> Column:
    return x / (1.0 + x / cap)


def _count(*conditions: Column) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + c.cast("int")
    return out


def entry_labels(bars: DataFrame, cfg: LabelConfig) -> DataFrame:
    """symbol, ts, entry_label (1, 0 or null between), r_net, mae, exit_code, exit_wait, entry_weight, and what led to them.

    exit_code is 2 where the average ended the trade, else -3; exit_wait the bars held. A bar without a price has no label.
    With ``cfg.zero`` a price of 0 is one: a fall to it is a fall by all, and a gain from it is infinite (none: NaN).
    """
    close = F.col("close")
    priced = close.isNotNull() & ((close >= 0) if cfg.zero else (close > 0))
    rows = bars.where(priced).withColumn("before", F.lag("close").over(by())).withColumn("step", F.abs(ratio(close, F.col("before")) - 1))
    future, early = (1, cfg.future), (1, cfg.early)
    rows = rows.withColumns({
        "w": walk(cfg), "n_after": F.count("close").over(by().rowsBetween(*future)), "mean_px": _after(close, *future), "mean_early_px": _after(close, *early),
        "worst_px": _after(close, *future, F.min), "worst_early_px": _after(close, *early, F.min), "end_px": _after(close, *future, F.last),
        "path": _after(F.col("step"), *future, F.sum), "ahead": F.collect_list("close").over(by().rowsBetween(*future)),
    })
    net = lambda px: ratio(px, close) - 1 - cfg.cost
    none = F.col("n_after") == 0
    r = net(F.col("w.price"))
    mean = F.when(none, r).otherwise(net(F.col("mean_px")))
    end = net(F.when(none, F.col("w.price")).otherwise(F.col("end_px")))
    up = F.greatest(F.lit(0.0), end + cfg.cost)
    share = F.size(F.filter("ahead", lambda p: net(p) > 0)) / F.nullif(F.col("n_after"), F.lit(0))
    rows = rows.withColumns({
        "r_net": r, "future_mean": mean, "future_early_mean": F.coalesce(net(F.col("mean_early_px")), mean), "future_end": end,
        "future_worst": net(F.least(close, F.coalesce("worst_px", close))), "future_early_worst": net(F.least(close, F.coalesce("worst_early_px", close))),
        "future_positive": F.when(none, (end > 0).cast("double")).otherwise(share),
        "future_efficiency": clip(F.when(F.coalesce("path", F.lit(0.0)) > 1e-12, up / F.nullif(F.col("path"), F.lit(0.0))).otherwise((up > 0).cast("double")), 0.0, 1.0),
        "mae": ratio(F.col("w.worst"), close) - 1, "exit_code": F.when(F.col("w.out") > 0, 2).otherwise(-3),
        "exit_wait": F.when(F.col("w.out") > 0, F.col("w.out")).otherwise(F.col("w.k")),
    })
    down = lambda c: F.abs(F.least(F.lit(0.0), F.col(c)))
    plus = lambda c: F.greatest(F.lit(0.0), F.col(c))
    bias = clip(2 * F.col("future_positive") - 1, 0.0, 1.0)
    rows = rows.withColumns({
        "risk_score": F.col("future_mean") - cfg.drawdown_penalty * down("future_worst"),
        "consistency": _saturated(plus("future_mean"), cfg.mean_cap) + cfg.early_gain * _saturated(plus("future_early_mean"), cfg.early_cap)
        + cfg.end_gain * _saturated(plus("future_end"), cfg.end_cap) + cfg.efficiency_gain * F.pow("future_efficiency", F.lit(1.5)) + cfg.positive_gain * F.pow(bias, F.lit(1.5))
        - cfg.early_penalty * down("future_early_worst") - cfg.drawdown_penalty * down("future_worst"),
    })
    # what a good entry has to be above, and what counts against a poor one
    tests = [
        ("future_mean", cfg.mean, cfg.neg_mean), ("future_early_mean", cfg.early_mean, cfg.neg_early_mean), ("future_early_worst", cfg.early_worst, cfg.neg_early_worst),
        ("risk_score", cfg.risk, cfg.neg_risk), ("future_end", cfg.end, cfg.neg_end), ("future_efficiency", cfg.efficiency, cfg.neg_efficiency),
        ("future_positive", cfg.positive, cfg.neg_positive), ("consistency", cfg.consistency, cfg.neg_consistency), ("mae", cfg.mae, cfg.neg_mae),
    ]
    good, poor = F.col("r_net") > cfg.profit, ~(F.col("r_net") > cfg.profit)
    if not cfg.profit_only:
        for name, least, _ in tests:
            good = good & (F.col(name) > least)
        if cfg.no_dip:
            good = good & (F.col("w.worst") >= close)
        poor = (F.col("r_net") < cfg.neg_profit) & (_count(*(F.col(name) < most for name, _, most in tests)) >= cfg.neg_failures)
    between = F.lit(None).cast("double") if cfg.neutral and not cfg.profit_only else F.lit(0.0)
    rows = rows.withColumn("entry_label", F.when(good, 1.0).when(poor, 0.0).otherwise(between))
    return rows.withColumn("entry_weight", _weight(cfg)).select(
        "symbol", "ts", "entry_label", "r_net", "mae", "exit_code", "exit_wait", "entry_weight", "future_mean", "future_early_mean", "future_worst", "future_early_worst",
        "future_end", "future_positive", "future_efficiency", "risk_score", "consistency",
    )


def _weight(cfg: LabelConfig) -> Column:
    positive = F.coalesce(F.col("entry_label") >= 1, F.lit(False))
    if cfg.weight == "return":
        part = lambda x, scale, gain, power: gain * F.pow(clip((x - cfg.deadzone) / scale, 0.0, 1.0), F.lit(power))
        won, lost = part(F.col("r_net"), cfg.scale_pos, cfg.gain_pos, cfg.power_pos), part(-F.col("r_net"), cfg.scale_neg, cfg.gain_neg, cfg.power_neg)
        return clip(F.when(positive, won).otherwise(lost), 0.0, cfg.weight_max)
    name = {"size": "r_net", "mean": "future_mean", "directed": "future_mean", "risk": "risk_score", "consistency": "consistency"}[cfg.weight]
    x = F.col(name)
    if cfg.weight in ("size", "mean"):
        size = F.abs(x)
    else:
        up, down = (cfg.pos_scale, cfg.neg_scale) if cfg.weight == "consistency" else (1.0, 1.0)
        size = F.when(positive, up * F.greatest(F.lit(0.0), x)).otherwise(down * F.greatest(F.lit(0.0), -x))
    return cfg.weight_max * F.pow(clip(size * 100, 0.0, cfg.weight_max) / cfg.weight_max, F.lit(cfg.weight_power))


def gap_veto(labels: DataFrame, gaps: DataFrame) -> DataFrame:
    """Label 0 and code -4 where a gap comes before the exit; ``gaps`` has symbol, ts and gap_in (rows to the bar after it)."""
    rows = labels.join(gaps.select("symbol", "ts", "gap_in"), ["symbol", "ts"], "left")
    hit = F.coalesce(F.col("gap_in") <= F.col("exit_wait"), F.lit(False))
    return rows.withColumn("entry_label", F.when(hit, 0.0).otherwise(F.col("entry_label"))).withColumn("exit_code", F.when(hit, -4).otherwise(F.col("exit_code"))).drop("gap_in")


def active(labels: DataFrame) -> DataFrame:
    """Adds ``active``: whether any positive entry's trade covers the bar. Each trade adds one at its entry and takes it off after its exit."""
    rows = labels.withColumn("n", F.row_number().over(by()))
    entered = rows.where("entry_label >= 0.5 and exit_wait >= 0")
    events = entered.select("symbol", F.col("n").alias("at"), F.lit(1).alias("d")).union(entered.select("symbol", F.col("n") + F.col("exit_wait") + 1, F.lit(-1)))
    change = events.groupBy("symbol", F.col("at").alias("n")).agg(F.sum("d").alias("d"))
    rows = rows.join(change, ["symbol", "n"], "left")
    return rows.withColumn("active", F.coalesce(F.sum("d").over(by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) > 0).drop("n", "d")


def exit_mask(labels: DataFrame, mode: str = "trade") -> DataFrame:
    """Adds ``exit_mask``: the bars that teach the exit: ``all``, only where a trade is entered (``entry``), or while one lasts (``trade``)."""
    if mode == "all":
        return labels.withColumn("exit_mask", F.lit(True))
    if mode == "entry":
        return labels.withColumn("exit_mask", F.coalesce(F.col("entry_label") >= 0.5, F.lit(False)))
    if mode != "trade":
        raise ValueError(f"mode is all, entry or trade, not {mode}")
    return active(labels).withColumnRenamed("active", "exit_mask")


def any_window(labels: DataFrame, names: list[str], weights: list[str]) -> DataFrame:
    """entry_label and entry_weight of several windows together: the largest that is not null, 0 if none is."""
    most = lambda cs: F.coalesce(F.greatest(*cs) if len(cs) > 1 else F.col(cs[0]), F.lit(0.0))
    return labels.withColumn("entry_label", most(names)).withColumn("entry_weight", most(weights))


def exit_spans(bars: DataFrame, spans: list[int], horizon: int, hold: int = 1, confirm: int = 2, cost: float = 0.0, offset: float = 0.0, ret_scale: float = 0.03, edge_scale: float = 0.01, blend: float = 0.35, tol_rel: float = 0.25, tol_abs: float = 0.0015) -> DataFrame:
    """symbol, ts, span_q25, span_q50, span_q75, span_weight, span_entropy: which average would have left a trade best.

    For each span the trade ends after ``confirm`` closes in a row below the average, not before ``hold`` bars, else at
    the horizon; its return, blended with the return for its speed, is what spans are compared by. The plateau of spans
    near the best gives the quantiles, its width the entropy, and both with the lead over other spans the weight. Bars
    with no more than ``hold`` bars ahead are left out.
    """
    close = F.col("close")
    rows = bars.where(close > 0).withColumn("ahead", F.collect_list("close").over(by().rowsBetween(1, horizon)))
    rows = rows.where(F.size("ahead") > hold)

    def leave(span: int) -> Column:
        alpha = 2.0 / (max(2, span) + 1.0)
        start = F.struct((close * (1 - offset)).alias("ema"), F.lit(0).alias("k"), F.lit(0).alias("streak"), F.lit(0).alias("out"))

        def step(acc: Column, p: Column) -> Column:
            ema, k = acc["ema"] + alpha * (p - acc["ema"]), acc["k"] + 1
            streak = F.when((k >= hold) & (p < ema), acc["streak"] + 1).otherwise(0)
            new = F.struct(ema.alias("ema"), k.alias("k"), streak.alias("streak"), F.when(streak >= confirm, k).otherwise(0).alias("out"))
            return F.when(acc["out"] > 0, acc).otherwise(new)

        return F.aggregate("ahead", start, step)["out"]

    rows = rows.withColumn("left", F.array(*map(leave, spans)))
    rows = rows.withColumn("held", F.transform("left", lambda k: F.when(k > 0, k).otherwise(F.size("ahead")))).drop("left")
    rows = rows.withColumn("rets", F.transform("held", lambda k: F.element_at("ahead", k) / close - 1 - cost))

    def objective(r: Column, k: Column) -> Column:
        speed = clip(F.lit(float(max(1, horizon))) / F.greatest(k, F.lit(1)), 0.25, 4.0)
        return (1 - blend) * r + blend * F.when(r >= 0, r * speed).otherwise(r / speed)

    m = len(spans)
    rows = rows.withColumn("obj", F.zip_with("rets", "held", objective)).withColumn("best", F.array_max("obj"))
    rows = rows.withColumn("at", F.array_position("obj", F.col("best")).cast("int"))
    tol = F.greatest(F.lit(tol_abs), tol_rel * F.greatest(F.abs("best"), F.lit(ret_scale * 0.25)), F.lit(1e-6))
    near = F.transform("obj", lambda o: F.col("best") - o <= tol)
    rows = rows.withColumn("near", near)
    far = lambda lo, hi, pick, other: F.coalesce(pick(F.filter(F.sequence(lo, hi), lambda i: ~F.element_at("near", i))), other)
    rows = rows.withColumn("left", F.when(F.col("at") > 1, far(F.lit(1), F.greatest(F.col("at") - 1, F.lit(1)), F.array_max, F.lit(0)) + 1).otherwise(1))
    rows = rows.withColumn("right", F.when(F.col("at") < m, far(F.least(F.col("at") + 1, F.lit(m)), F.lit(m), F.array_min, F.lit(m + 1)) - 1).otherwise(m))
    outside = F.array_max(F.filter("obj", lambda o, i: (i + 1 < F.col("left")) | (i + 1 > F.col("right"))))
    width = (F.col("right") - F.col("left")) / float(max(1, m - 1))
    edge = F.coalesce(clip((F.col("best") - outside) / edge_scale, 0.0, 1.0), F.lit(0.0))
    sure = 0.55 * edge + 0.25 * clip(F.abs(F.array_max("rets")) / ret_scale, 0.0, 1.0) + 0.20 * (1 - width)
    at = lambda c: F.element_at(F.array(*(F.lit(float(s)) for s in spans)), F.col(c))
    return rows.select(
        "symbol", "ts", at("left").alias("span_q25"), at("at").alias("span_q50"), at("right").alias("span_q75"),
        (1 + 6 * F.pow(clip(sure, 0.0, 1.0), F.lit(2.2))).alias("span_weight"), width.alias("span_entropy"),
    )


def future_mean_labels(bars: DataFrame, end: int = 24, split: int = 12, early: int = 6, profit: float = 0.01, efficiency: float = 0.10, adverse: float = 0.008) -> DataFrame:
    """Long and short labels from mean returns ahead, for bars whose whole horizon is there; others have nothing ahead.

    Returns symbol, ts, valid, future_eff, mean_early, mean_full, early_worst, early_best, core_long, core_short, long, short.
    """
    close = F.col("close")
    rows = bars.where(close > 0).withColumn("step", F.abs(close - F.lag("close").over(by())))
    rows = rows.withColumns({
        "end_px": F.lead("close", end).over(by()), "path": _after(F.col("step"), 1, end, F.sum), "m_early": _after(close, 1, split), "m_full": _after(close, 1, end),
        "lo": _after(close, 1, early, F.min), "hi": _after(close, 1, early, F.max),
    })
    ok = F.col("end_px").isNotNull()
    valid = lambda x: F.when(ok, x).otherwise(F.lit(0.0))
    rows = rows.withColumns({
        "valid": ok, "future_eff": valid(F.when(F.col("path") > 1e-12, F.abs(F.col("end_px") - close) / F.col("path")).otherwise(0.0)),
        "mean_early": valid(F.col("m_early") / close - 1), "mean_full": valid(F.col("m_full") / close - 1),
        "early_worst": valid(F.least(F.lit(0.0), F.col("lo") / close - 1)), "early_best": valid(F.greatest(F.lit(0.0), F.col("hi") / close - 1)),
    })
    both = F.col("valid") & (F.col("future_eff") >= efficiency)
    rows = rows.withColumn("core_long", F.col("valid") & (F.col("mean_early") >= profit) & (F.col("mean_full") >= profit))
    rows = rows.withColumn("core_short", F.col("valid") & (F.col("mean_early") <= -profit) & (F.col("mean_full") <= -profit))
    rows = rows.withColumn("long", F.col("core_long") & both & (-F.col("early_worst") <= adverse)).withColumn("short", F.col("core_short") & both & (F.col("early_best") <= adverse))
    return rows.select("symbol", "ts", "valid", "future_eff", "mean_early", "mean_full", "early_worst", "early_best", "core_long", "core_short", "long", "short")


def funnel(labels: DataFrame, profit: float = 0.01, efficiency: float = 0.10, adverse: float = 0.008) -> DataFrame:
    """For each side how many bars pass each test of ``future_mean_labels``, and what keeps bars with enough return out."""
    eff = F.col("future_eff") >= efficiency
    out = None
    for side, sign, adverse_move in (("long", 1, -F.col("early_worst")), ("short", -1, F.col("early_best"))):
        early, full, calm, core = sign * F.col("mean_early") >= profit, sign * F.col("mean_full") >= profit, adverse_move <= adverse, F.col(f"core_{side}")
        tests = {
            "window": F.lit(True), "mean_early_ok": early, "mean_full_ok": full, "mean_pair_ok": early & full, "efficient": eff, "early_ok": calm, "final": F.col(side),
            "core": core, "cut_efficiency": core & ~eff, "cut_mean_pair": core & ~(early & full), "cut_early": core & ~calm, "cut_any": core & ~(eff & calm & early & full),
        }
        row = labels.where("valid").agg(*(F.count_if(c).alias(k) for k, c in tests.items())).select(F.lit(side).alias("side"), *tests)
        out = row if out is None else out.union(row)
    return out


def sharpened(x: Column, start: float = 0.58, power: float = 3.0) -> Column:
    return F.pow(clip((x - start) / (1.0 - start), 0.0, 1.0), F.lit(power))


def quality_weight(labels: DataFrame, profit: float = 0.01, efficiency: float = 0.10, adx: tuple[str, ...] = ("adx_30",)) -> DataFrame:
    """Adds ``quality_weight`` from 0 to 7: how plainly a bar is what its label says, by efficiency, return and trend."""
    trend = F.lit(0.0)
    have = [c for c in adx if c in labels.columns]
    for c in have:
        trend = trend + F.coalesce(clip((F.col(c) - 12.0) / 23.0, 0.0, 1.0), F.lit(0.0)) / len(have)
    eff = clip((F.col("future_eff") - efficiency) / max(1e-9, 0.50 - efficiency), 0.0, 1.0)
    part = lambda sign: clip(0.60 * clip(sign * (F.col("mean_early") - profit) / profit, 0.0, 1.0) + 0.40 * clip(sign * (F.col("mean_full") - profit) / profit, 0.0, 1.0), 0.0, 1.0)
    good = clip(0.40 * eff + 0.35 * part(1) + 0.25 * trend, 0.0, 1.0)
    bad = clip(0.40 * (1 - eff) + 0.35 * part(-1) + 0.25 * (1 - trend), 0.0, 1.0)
    return labels.withColumn("quality_weight", 7 * F.when(F.col("long"), sharpened(good)).otherwise(sharpened(bad)))


def first_hit(bars: DataFrame, up: float, down: float, horizon: int) -> DataFrame:
    """symbol, ts, target_in, stop_in: rows until a close is up or down by a share, within the horizon, null if never."""
    rows = bars.where("close > 0").withColumn("ahead", F.collect_list("close").over(by().rowsBetween(1, horizon)))
    reach = lambda test: F.nullif(F.array_position(F.transform("ahead", test), F.lit(True)), F.lit(0).cast("long"))
    return rows.select("symbol", "ts", reach(lambda p: p >= F.col("close") * (1 + up)).alias("target_in"), reach(lambda p: p <= F.col("close") * (1 - down)).alias("stop_in"))


def exit_span_bars(span: int, windows_minutes: list[float], candle: int) -> int:
    """Bars of the exit average: the span if one is given, else the first window, else 0."""
    if span > 0:
        return span
    return max(1, round(windows_minutes[0] * 60 / max(1, candle))) if windows_minutes else 0
