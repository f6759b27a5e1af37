"""Technical features of bars, planned in stages.

Every feature says which columns it needs and in which stage they can be computed; equal columns are computed once. All
window columns of a stage go into one projection, so Spark sorts a symbol's bars once for all of them, and exponential
averages of all features share one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquill.functions import rolling as R
from barquill.functions.recursive import averages, span
from barquill.operators.bars import bars_of_minutes, segments

EPS = R.EPS

# Windows of each block, in minutes; pairs are short and long.
WINDOWS: dict[str, tuple] = {
    "shitidx": ((60, 240), (240, 1440), (720, 4320)),
    "atr": (30, 60, 240, 1440),
    "keltner_width": (30, 60, 240),
    "keltner_center": (60, 240, 720, 1440),
    "keltner_pos": (240, 1440, 4320),
    "keltner_z": (240, 1440),
    "rsi": (30, 60, 240),
    "rsi_ema": ((30, 60), (60, 240)),
    "slope": (30, 60, 240, 720),
    "vol": (60, 240, 720, 1440, 10080),
    "ci": (60, 240),
    "cum_logret": (60, 240, 1440),
    "cci": (60, 240, 1440),
    "adx": (30, 60, 240),
    "time_since": (30, 60, 240, 720, 1440),
    "zlog": (240, 1440),
    "slope_reserr": (240, 720, 1440, 4320),
    "vol_ratio": ((60, 240), (240, 1440)),
    "regime": (1440, 60),
    "liquidity": (60, 240, 1440),
    "rev_speed": (30, 60, 240),
    "vol_z": ((30, 240),),
    "shadow": (10,),
    "range_ratio": ((30, 240), (240, 1440)),
    "eff": (30, 60, 240, 720, 1440),
    "runs": (30, 60, 240),
    "hh_hl": (60, 240),
    "ema_cross": (30, 60, 240),
    "breakout": (60, 240, 1440),
    "mom_short": ((30, 60), (60, 240)),
    "wick_stats": (30, 60),
}


@dataclass(frozen=True)
class FeatureConfig:
    """``candle``: seconds of a bar; ``windows`` replaces those of some blocks; ``warm_up``: full, half or progressive.

    ``nulls``: a null in a window over windows is passed over (``skip``) or spoils all that comes after it in its segment (``poison``).
    """

    candle: int = 300
    windows: dict[str, tuple] = field(default_factory=dict)
    warm_up: str = "full"
    nulls: str = "skip"

    def of(self, block: str) -> tuple:
        return self.windows.get(block, WINDOWS[block])

    def bars(self, minutes: float) -> int:
        return bars_of_minutes(minutes, self.candle)

    def minp(self, n: int) -> int:
        return {"full": n, "half": max(1, n // 2), "progressive": 1}[self.warm_up]

    def history(self, blocks: Iterable[str] | None = None) -> int:
        """Minutes that the longest window reaches back."""
        sizes = [x for b in blocks or WINDOWS for w in self.of(b) for x in (w if isinstance(w, tuple) else (w,))]
        return max(sizes)


class Stages:
    """Columns by stage: from neighbours, averages, from windows, from those, from windows over those, averages of those, last."""

    def __init__(self, cfg: FeatureConfig):
        self.cfg = cfg
        self.base: dict[str, Column] = {}
        self.average: dict[str, tuple] = {}
        self.roll: dict[str, Column] = {}
        self.mid: dict[str, Column] = {}
        self.roll2: dict[str, Column] = {}
        self.average2: dict[str, tuple] = {}
        self.out: dict[str, Column] = {}
        self.last: dict[str, Column] = {}

    def ema(self, source: str, n: int, value: Callable | None = None) -> Column:
        name = f"_ema_{source}_{n}"
        self.average[name] = (name, value or (lambda pdf: pdf[source]), span(n), self.cfg.minp(n))
        return F.col(name)

    def window(self, kind: str, source: str, n: int, minp: int | None = None) -> Column:
        minp = self.cfg.minp(n) if minp is None else minp
        name = f"_{kind}_{source}_{n}_{minp}"
        self.roll[name] = getattr(R, kind)(source, n, minp)
        return F.col(name)


def _neighbours() -> dict[str, Column]:
    """What a bar has from itself and the one before."""
    last, wide = R.before("close"), F.col("high") - F.col("low")
    change = F.coalesce(F.col("close") - last, F.lit(0.0))
    up, down = F.greatest(F.col("high") - R.before("high"), F.lit(0.0)), F.greatest(R.before("low") - F.col("low"), F.lit(0.0))
    log = F.log(F.col("close") + EPS)
    return {
        "_tr": R.true_range(),
        "_tr_share": R.true_range() / (F.col("close") + EPS),
        "_typical": (F.col("high") + F.col("low") + F.col("close")) / 3.0,
        "_log": log,
        "_logret": F.coalesce(log - F.log(last + EPS), F.lit(0.0)),
        "_ret": F.coalesce((F.col("close") - last) / (last + EPS), F.lit(0.0)),
        "_gain": F.greatest(change, F.lit(0.0)),
        "_loss": F.greatest(-change, F.lit(0.0)),
        "_up": (change > 0).cast("double"),
        "_down": (change < 0).cast("double"),
        "_is_up": change > 0,
        "_is_down": change < 0,
        "close_step": F.abs(F.col("close") - last),
        "_dm_up": F.coalesce(F.when(up >= down, up).otherwise(F.lit(0.0)), F.lit(0.0)),
        "_dm_down": F.coalesce(F.when(down > up, down).otherwise(F.lit(0.0)), F.lit(0.0)),
        "_notional": F.col("volume") * F.col("close"),
        "_range_share": wide / (F.col("close") + EPS),
        "_logvol": F.log1p("volume"),
        "_sign": F.coalesce(F.signum(F.col("close") / (last + EPS) - 1.0), F.lit(0.0)),
        "_shadow": (F.col("high") - F.greatest("open", "close") - (F.least("open", "close") - F.col("low"))) / (wide + EPS),
        "_wick": R.clip((F.least("open", "close") - F.col("low")) / (wide + EPS), 0.0, 1.0),
        "_higher": R.yes(F.col("high") > R.before("high")).cast("double"),
        "_higher_low": R.yes(F.col("low") > R.before("low")).cast("double"),
    }


def _index(gain: Column, loss: Column) -> Column:
    return 100.0 - 100.0 / (1.0 + gain / (loss + EPS))


def shitidx(s: Stages) -> None:
    for a, b in s.cfg.of("shitidx"):
        s.out[f"shitidx_pct_{a}_{b}"] = (s.ema("close", s.cfg.bars(a)) - s.ema("close", s.cfg.bars(b))) / (F.col("close") + EPS) * 100


def atr(s: Stages) -> None:
    for m in s.cfg.of("atr"):
        s.out[f"atr_pct_{m}"] = s.window("mean", "_tr", s.cfg.bars(m)) / (F.col("close") + EPS) * 100


def keltner(s: Stages) -> None:
    share = F.col("close") + EPS
    for m in s.cfg.of("keltner_width"):
        s.out[f"keltner_halfwidth_pct_{m}"] = 2 * s.window("mean", "_tr", s.cfg.bars(m)) / share * 100
    for m in s.cfg.of("keltner_center"):
        s.out[f"keltner_center_pct_{m}"] = (s.ema("close", s.cfg.bars(m)) - F.col("close")) / share * 100
    for m in s.cfg.of("keltner_pos"):
        n = s.cfg.bars(m)
        half = 2 * s.window("mean", "_tr", n)
        s.out[f"keltner_pos_{m}"] = (F.col("close") - s.ema("close", n) + half) / (2 * half + EPS)
    for m in s.cfg.of("keltner_z"):
        wide, n = f"_width_{m}", s.cfg.bars(2 * m)
        minp = max(1, min(n, max(n // 2, s.cfg.bars(60))))
        s.mid[wide] = 4 * s.window("mean", "_tr", s.cfg.bars(m)) / share * 100
        s.roll2[f"{wide}_mean"], s.roll2[f"{wide}_dev"] = R.mean(wide, n, minp), R.deviation(wide, n, minp)
        s.out[f"keltner_width_z_{m}"] = (F.col(wide) - F.col(f"{wide}_mean")) / (F.col(f"{wide}_dev") + EPS)
        if s.cfg.nulls == "poison":
            s.roll2[f"{wide}_gone"] = F.count_if(F.col(wide).isNull()).over(R.so_far())
            s.out[f"keltner_width_z_{m}"] = F.when(F.col(f"{wide}_gone") == 0, s.out[f"keltner_width_z_{m}"])


def rsi(s: Stages) -> None:
    for m in s.cfg.of("rsi"):
        n = s.cfg.bars(m)
        s.out[f"rsi_price_{m}"] = _index(s.window("mean", "_gain", n), s.window("mean", "_loss", n))
    for a, m in s.cfg.of("rsi_ema"):
        smooth, n, minp = s.ema("close", s.cfg.bars(a)), s.cfg.bars(m), s.cfg.minp(s.cfg.bars(m))
        step = smooth - R.before(smooth)
        up, down = f"_ema_gain_{a}", f"_ema_loss_{a}"
        s.mid[up] = F.coalesce(F.greatest(F.when(step.isNotNull(), step), F.lit(0.0)), F.lit(0.0))
        s.mid[down] = F.coalesce(F.greatest(F.when(step.isNotNull(), -step), F.lit(0.0)), F.lit(0.0))
        s.roll2[f"{up}_{m}"], s.roll2[f"{down}_{m}"] = R.mean(up, n, minp), R.mean(down, n, minp)
        s.out[f"rsi_ema{a}_{m}"] = _index(F.col(f"{up}_{m}"), F.col(f"{down}_{m}"))


def _slope(s: Stages, m: int) -> Column:
    n = s.cfg.bars(m)
    s.roll[f"_slope_{n}"] = F.when(F.col("rn") >= s.cfg.minp(n), R.slope("_log", n))
    return F.col(f"_slope_{n}")


def slope(s: Stages) -> None:
    for m in s.cfg.of("slope"):
        s.out[f"slope_pct_{m}"] = _slope(s, m)


def vol(s: Stages) -> None:
    for m in s.cfg.of("vol"):
        s.out[f"vol_pct_{m}"] = s.window("deviation", "_ret", s.cfg.bars(m)) * 100


def ci(s: Stages) -> None:
    for m in s.cfg.of("ci"):
        n = s.cfg.bars(m)
        s.roll[f"_path_{n}"] = F.when(F.col("rn") >= max(2, s.cfg.minp(n)), F.sum("close_step").over(R.frame(n)))
        wide = s.window("highest", "close", n) - s.window("lowest", "close", n)
        s.out[f"ci_{m}"] = 100 * F.log10(F.col(f"_path_{n}") / (wide + EPS) + EPS) / F.nullif(F.log10(F.lit(float(n))), F.lit(0.0))


def cum_logret(s: Stages) -> None:
    for m in s.cfg.of("cum_logret"):
        s.out[f"cum_ret_pct_{m}"] = (F.exp(s.window("total", "_logret", s.cfg.bars(m))) - 1) * 100


def cci(s: Stages) -> None:
    # 0.797...: mean absolute deviation of a normal distribution against its standard deviation, sqrt(2 / pi)
    for m in s.cfg.of("cci"):
        n = s.cfg.bars(m)
        s.out[f"cci_{m}"] = (F.col("_typical") - s.window("mean", "_typical", n)) / (0.015 * (s.window("deviation", "_typical", n) * 0.7978845608028654 + EPS))


def adx(s: Stages) -> None:
    for m in s.cfg.of("adx"):
        n = s.cfg.bars(m)
        up, down, wide = (s.window("total", x, n) for x in ("_dm_up", "_dm_down", "_tr"))
        plus, minus = up / (wide + EPS) * 100, down / (wide + EPS) * 100
        s.mid[f"_dx_{m}"] = F.abs(plus - minus) / (plus + minus + EPS) * 100
        s.average2[f"adx_{m}"] = (f"adx_{m}", lambda pdf, m=m: pdf[f"_dx_{m}"], 1.0 / n, s.cfg.minp(n))
        s.last[f"adx_{m}"] = F.col(f"adx_{m}")


def time_since(s: Stages) -> None:
    for m in s.cfg.of("time_since"):
        n = s.cfg.bars(m)
        low, high = s.window("lowest", "close", n), s.window("highest", "close", n)
        s.out[f"pct_from_min_{m}"] = (F.col("close") - low) / (low + EPS) * 100
        s.out[f"pct_from_max_{m}"] = (high - F.col("close")) / (high + EPS) * 100
        s.out[f"time_since_min_{m}"] = s.window("since_lowest", "close", n)
        s.out[f"time_since_max_{m}"] = s.window("since_highest", "close", n)


def zlog(s: Stages) -> None:
    for m in s.cfg.of("zlog"):
        n = s.cfg.bars(m)
        s.out[f"zlog_{m}m"] = (F.col("_log") - s.window("mean", "_log", n)) / (s.window("deviation", "_log", n) + EPS)


def slope_reserr(s: Stages) -> None:
    for m in s.cfg.of("slope_reserr"):
        n = s.cfg.bars(m)
        s.roll[f"_residual_{n}"] = R.residual_error("_log", n)
        s.out[f"slope_reserr_pct_{m}"] = (F.exp(F.col(f"_residual_{n}")) - 1) * 100


def vol_ratio(s: Stages) -> None:
    for a, b in s.cfg.of("vol_ratio"):
        short, long = (s.window("deviation", "_ret", s.cfg.bars(m)) * 100 for m in (a, b))
        s.out[f"vol_ratio_pct_{a}_{b}"] = (short / (long + EPS) - 1) * 100


def regime(s: Stages) -> None:
    long, short = s.cfg.of("regime")
    s.out["log_volume_ema"] = F.log1p(s.ema("_notional", s.cfg.bars(long)))
    traded, moved = s.ema("_notional", s.cfg.bars(short)), s.ema("_tr_share", s.cfg.bars(short))
    s.out["liquidity_ratio"] = F.log1p(F.when(traded.isNotNull(), F.greatest(F.lit(0.0), traded / (moved + EPS))))


def liquidity(s: Stages) -> None:
    import numpy as np

    n = max(2, s.cfg.bars(10))
    s.ema("_notional", n)
    s.ema("_range_share", n)
    for m in s.cfg.of("liquidity"):
        ratio = lambda pdf, n=n: np.log1p(pdf[f"_ema__notional_{n}"] / (pdf[f"_ema__range_share_{n}"] + EPS))
        s.out[f"volume_to_range_ema{m}"] = s.ema(f"ratio{n}", s.cfg.bars(m), ratio)


def rev_speed(s: Stages) -> None:
    for m in s.cfg.of("rev_speed"):
        n = s.cfg.bars(m)
        s.out[f"rev_speed_up_{m}"] = (F.col("close") / (s.window("lowest", "close", n) + EPS) - 1) * 100 / (s.window("since_lowest", "close", n) + 1)
        s.out[f"rev_speed_down_{m}"] = (s.window("highest", "close", n) / (F.col("close") + EPS) - 1) * 100 / (s.window("since_highest", "close", n) + 1)


def vol_z(s: Stages) -> None:
    for a, b in s.cfg.of("vol_z")[:1]:
        short, long = s.cfg.bars(a), s.cfg.bars(b)
        mean = s.ema("_logvol", short)
        s.ema("_logvol", long)
        apart = s.ema(f"volapart{long}", long, lambda pdf, n=long: (pdf["_logvol"] - pdf[f"_ema__logvol_{n}"]).abs())
        s.out["vol_z"] = (F.col("_logvol") - mean) / (apart + EPS)
        s.out["signed_vol_z"] = s.out["vol_z"] * F.col("_sign")


def shadow(s: Stages) -> None:
    s.out["shadow_balance_raw"] = F.col("_shadow")
    s.out["shadow_balance"] = s.ema("shadowclip", max(2, s.cfg.bars(s.cfg.of("shadow")[0])), lambda pdf: pdf["_shadow"].clip(-1.0, 1.0))


def range_ratio(s: Stages) -> None:
    for a, b in s.cfg.of("range_ratio"):
        short, long = (s.window("highest", "high", s.cfg.bars(m)) - s.window("lowest", "low", s.cfg.bars(m)) for m in (a, b))
        s.out[f"range_ratio_{a}_{b}"] = short / (long + EPS)


def eff(s: Stages) -> None:
    for m in s.cfg.of("eff"):
        n = max(2, s.cfg.bars(m))
        s.roll[f"_eff_{n}"] = R.efficiency("close", n)
        s.out[f"eff_{m}"] = F.col(f"_eff_{n}")


def runs(s: Stages) -> None:
    for m in s.cfg.of("runs"):
        s.out[f"run_up_cnt_{m}"] = s.window("total", "_up", s.cfg.bars(m), 1)
        s.out[f"run_dn_cnt_{m}"] = s.window("total", "_down", s.cfg.bars(m), 1)
    s.roll["_run_up"], s.roll["_run_down"] = R.run("_is_up"), R.run("_is_down")
    s.out["run_up_len"], s.out["run_dn_len"] = F.col("_run_up"), F.col("_run_down")


def hh_hl(s: Stages) -> None:
    for m in s.cfg.of("hh_hl"):
        s.out[f"hh_cnt_{m}"] = s.window("total", "_higher", s.cfg.bars(m), 1)
        s.out[f"hl_cnt_{m}"] = s.window("total", "_higher_low", s.cfg.bars(m), 1)


def ema_cross(s: Stages) -> None:
    for m in s.cfg.of("ema_cross"):
        mean = s.ema("close", s.cfg.bars(m))
        above, below, side = f"_above_{m}", f"_below_{m}", f"_side_{m}"
        s.mid[above], s.mid[below] = R.yes(F.col("close") > mean), R.yes(F.col("close") < mean)
        s.mid[side] = F.last(F.nullif(F.signum(F.col("close") - mean), F.lit(0.0)), ignorenulls=True).over(R.so_far())
        s.roll2[f"bars_above_ema_{m}"], s.roll2[f"bars_below_ema_{m}"] = R.run(above), R.run(below)
        s.roll2[f"_turned_{m}"] = R.yes(F.col(side) != F.lag(side).over(R.ordered()))
        for name in (f"bars_above_ema_{m}", f"bars_below_ema_{m}"):
            s.out[name] = F.col(name)
        s.last[f"bars_since_cross_{m}"] = R.since_true(f"_turned_{m}")


def breakout(s: Stages) -> None:
    for m in s.cfg.of("breakout"):
        n = s.cfg.bars(m)
        high, low = s.window("highest", "high", n), s.window("lowest", "low", n)
        s.mid[f"_over_{m}"], s.mid[f"_under_{m}"] = R.yes(F.col("close") > R.before(high) + EPS), R.yes(F.col("close") < R.before(low) - EPS)
        s.roll2[f"bars_since_bhigh_{m}"], s.roll2[f"bars_since_blow_{m}"] = R.since_true(f"_over_{m}"), R.since_true(f"_under_{m}")
        s.out[f"break_high_{m}"], s.out[f"break_low_{m}"] = F.col(f"_over_{m}").cast("double"), F.col(f"_under_{m}").cast("double")
        for name in (f"bars_since_bhigh_{m}", f"bars_since_blow_{m}"):
            s.out[name] = F.col(name)


def mom_short(s: Stages) -> None:
    for a, b in s.cfg.of("mom_short"):
        s.out[f"slope_diff_{a}_{b}"] = _slope(s, a) - _slope(s, b)


def wick_stats(s: Stages) -> None:
    s.mid["_long_wick"] = F.col("_wick") > 0.5
    s.roll2["wick_lower_streak"] = R.run("_long_wick")
    s.out["wick_lower_streak"] = F.col("wick_lower_streak")
    for m in s.cfg.of("wick_stats"):
        s.out[f"wick_lower_mean_{m}"] = s.window("mean", "_wick", s.cfg.bars(m), 1)


BLOCKS: dict[str, Callable[[Stages], None]] = {
    f.__name__: f
    for f in (
        shitidx, atr, keltner, rsi, slope, vol, ci, cum_logret, cci, adx, time_since, zlog, slope_reserr, vol_ratio, regime, liquidity,
        rev_speed, vol_z, shadow, range_ratio, eff, runs, hh_hl, ema_cross, breakout, mom_short, wick_stats,
    )
}


def build(bars: DataFrame, cfg: FeatureConfig | None = None, blocks: Iterable[str] | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """symbol, ts, close and the features of ``blocks`` (all unless given), or those of them in ``only``.

    Bars without prices are left out and start a new segment. Numbers that are not finite come out null.
    """
    s = Stages(cfg or FeatureConfig())
    for block in blocks or BLOCKS:
        BLOCKS[block](s)
    rows = segments(bars).withColumns(_neighbours())
    if s.average:
        rows = averages(rows, list(s.average.values()))
    for stage in (s.roll, s.mid, s.roll2):
        rows = rows.withColumns(stage) if stage else rows
    if s.average2:
        rows = averages(rows, list(s.average2.values()))
    names = {**s.out, **s.last}
    wanted = [c for c in names if only is None or c in set(only)]
    sound = lambda x: F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), x)
    return rows.select("symbol", "ts", "close", *(sound(names[c]).alias(c) for c in wanted))


# The features of each preset.
PRESETS = {
    "core80": """
        shitidx_pct_60_240 shitidx_pct_240_1440 shitidx_pct_720_4320 atr_pct_30 atr_pct_60 atr_pct_240 rsi_price_30 rsi_price_60 rsi_price_240 rsi_ema30_60
        slope_pct_30 slope_pct_60 slope_pct_240 slope_pct_720 vol_pct_60 vol_pct_240 vol_pct_720 vol_pct_1440 ci_60 cum_ret_pct_60 cum_ret_pct_240 cum_ret_pct_1440
        keltner_center_pct_60 keltner_center_pct_240 keltner_center_pct_1440 keltner_pos_240 keltner_halfwidth_pct_30 keltner_halfwidth_pct_60 keltner_halfwidth_pct_240 cci_60
        adx_30 adx_60 adx_240 pct_from_min_30 pct_from_min_60 pct_from_min_240 pct_from_min_720 pct_from_max_30 pct_from_max_60 pct_from_max_240 pct_from_max_720
        time_since_min_30 time_since_min_60 time_since_min_240 time_since_min_720 zlog_240m zlog_1440m slope_reserr_pct_240 slope_reserr_pct_720 slope_reserr_pct_1440
        vol_ratio_pct_60_240 vol_ratio_pct_240_1440 log_volume_ema liquidity_ratio volume_to_range_ema60 volume_to_range_ema240 rev_speed_up_30 rev_speed_down_30 rev_speed_up_240 rev_speed_down_240
        vol_z signed_vol_z shadow_balance shadow_balance_raw range_ratio_30_240 eff_30 eff_60 eff_240 eff_720 run_up_cnt_30 run_dn_cnt_30 run_up_cnt_240 run_dn_cnt_60 run_up_len
        hh_cnt_60 hl_cnt_60 hh_cnt_240 bars_above_ema_30 bars_above_ema_60 bars_since_cross_60 bars_above_ema_240 break_high_60 break_low_60 bars_since_bhigh_240 bars_since_blow_240
        slope_diff_30_60 wick_lower_mean_60
    """.split(),
    "core65": """
        shitidx_pct_60_240 shitidx_pct_240_1440 atr_pct_30 atr_pct_60 atr_pct_240 rsi_price_30 rsi_price_60 rsi_price_240 rsi_ema30_60 slope_pct_30 slope_pct_60 slope_pct_240
        vol_pct_60 vol_pct_240 vol_pct_720 vol_pct_1440 ci_60 cum_ret_pct_60 cum_ret_pct_240 keltner_center_pct_60 keltner_center_pct_240 keltner_center_pct_1440 keltner_pos_240 keltner_halfwidth_pct_60
        cci_60 adx_30 adx_60 pct_from_min_30 pct_from_min_60 pct_from_max_30 pct_from_max_60 time_since_min_30 time_since_min_60 time_since_max_30 time_since_max_60 zlog_240m
        slope_reserr_pct_240 slope_reserr_pct_720 slope_reserr_pct_1440 vol_ratio_pct_60_240 log_volume_ema liquidity_ratio volume_to_range_ema60 volume_to_range_ema240
        rev_speed_up_30 rev_speed_down_30 rev_speed_up_240 rev_speed_down_240 vol_z signed_vol_z shadow_balance_raw range_ratio_30_240 eff_30 eff_60 eff_240 eff_720
        run_up_cnt_30 run_dn_cnt_30 run_up_cnt_240 run_up_len hh_cnt_60 hl_cnt_60 bars_above_ema_60 bars_since_cross_60 bars_above_ema_240 break_high_60 break_low_60 bars_since_bhigh_240
        slope_diff_30_60 wick_lower_mean_60
    """.split(),
    "core50": """
        shitidx_pct_60_240 shitidx_pct_240_1440 atr_pct_30 atr_pct_60 rsi_price_30 rsi_price_60 rsi_ema30_60 slope_pct_30 slope_pct_60 slope_pct_240 vol_pct_60 vol_pct_240 vol_pct_720
        cum_ret_pct_60 cum_ret_pct_240 keltner_center_pct_60 keltner_center_pct_240 keltner_center_pct_1440 keltner_pos_240 adx_30 adx_60 pct_from_min_30 pct_from_max_30
        time_since_min_30 time_since_max_30 zlog_240m slope_reserr_pct_240 slope_reserr_pct_720 vol_ratio_pct_60_240 log_volume_ema liquidity_ratio volume_to_range_ema60
        rev_speed_up_30 rev_speed_down_30 vol_z signed_vol_z shadow_balance_raw eff_30 eff_60 eff_240 run_up_cnt_30 run_dn_cnt_30 run_up_cnt_240 hh_cnt_60 hl_cnt_60
        bars_above_ema_60 bars_since_cross_60 break_high_60 break_low_60 wick_lower_mean_60
    """.split(),
}


def block_of(cfg: FeatureConfig | None = None) -> dict[str, str]:
    """The block that makes each feature."""
    out = {}
    for name, make in BLOCKS.items():
        s = Stages(cfg or FeatureConfig())
        make(s)
        out |= dict.fromkeys({**s.out, **s.last}, name)
    return out


def preset(name: str) -> tuple[list[str], list[str] | None]:
    """Blocks and features of a preset, for ``build``; ``full`` and nothing are all blocks and no choice of features."""
    if name.strip().lower() in ("", "default", "full", "all", "none"):
        return list(BLOCKS), None
    if name.strip().lower() not in PRESETS:
        raise ValueError(f"no preset is called {name}")
    names = PRESETS[name.strip().lower()]
    blocks = block_of()
    return sorted({blocks[x] for x in names}), names


def feature_columns(df: DataFrame, allowed: Iterable[str] | None = None) -> list[str]:
    """The columns that are features: numbers that are not prices, labels or bookkeeping, and not null throughout.

    One aggregation finds the columns without values.
    """
    out = [
        name for name, kind in df.dtypes
        if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") and name not in ("open", "high", "low", "close", "volume", "seg", "rn")
        and not name.startswith(("exit_", "sniper_", "label_", "cycle_", "_")) and (allowed is None or name in set(allowed))
    ]
    if not out:
        return out
    filled = df.agg(*(F.count(c).alias(c) for c in out)).first()
    return [c for c in out if filled[c]]


# Decimals that stored features keep, by the start of their name; the first that fits counts, others keep six.
DECIMALS = {
    "atr_pct_": 4, "vol_pct_": 4, "keltner_": 4, "slope_pct_": 5, "slope_reserr_pct_": 4, "vol_ratio_pct_": 4, "pct_from_": 4, "range_ratio_": 4,
    "rev_speed_": 5, "zlog_": 4, "signed_vol_z": 4, "vol_z": 4, "cci_": 1, "adx_": 1, "rsi_": 1, "log_volume_ema": 5, "liquidity_ratio": 4,
}


def compact(df: DataFrame, keep: Iterable[str] = ("symbol", "ts", "close"), digits: int = 6) -> DataFrame:
    """Features rounded by name for storage, as floats; times since something as whole numbers from 0 to 65535."""
    out = []
    for c in df.columns:
        if c in set(keep):
            out.append(F.col(c))
        elif c.startswith("time_since_"):
            out.append(F.greatest(F.lit(0), F.least(F.lit(65535), F.coalesce(c, F.lit(0)))).cast("int").alias(c))
        else:
            places = next((d for start, d in DECIMALS.items() if c.startswith(start)), digits)
            out.append(F.round(c, places).cast("float").alias(c))
    return df.select(*out)
