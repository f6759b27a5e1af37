"""Bars and features as queries over hourly bars of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.operators import bars as B
from barquill.operators.features import FeatureConfig, build
from barquill.plans.fixtures import BARS, hourly, ticks
from barquill.plans.registry import ORACLE_SQL, QUERIES, add

#: Hourly bars, so windows of 4, 12 and 24 rows.
CONFIG = FeatureConfig(
    candle=3600,
    windows={
        "shitidx": ((240, 720),), "atr": (240, 720), "keltner_width": (240,), "keltner_center": (240, 720), "keltner_pos": (720,), "keltner_z": (240,),
        "rsi": (240, 720), "rsi_ema": ((240, 720),), "slope": (240, 720), "vol": (240, 1440), "ci": (240, 720), "cum_logret": (240, 720), "cci": (720,),
        "adx": (240, 720), "time_since": (240, 1440), "zlog": (720,), "slope_reserr": (240, 720), "vol_ratio": ((240, 720),), "regime": (1440, 240),
        "liquidity": (240,), "rev_speed": (240, 720), "vol_z": ((240, 720),), "shadow": (180,), "range_ratio": ((240, 720),), "eff": (240, 720),
        "runs": (240, 720), "hh_hl": (240,), "ema_cross": (240,), "breakout": (240, 720), "mom_short": ((240, 720),), "wick_stats": (240,),
    },
)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable values: decimals cut, minus zero as zero, dates as text.

    Halves are those of the scaled double, as in SQL engines; Spark's own rounding goes by the shortest decimal text.
    """
    scale = F.lit(10.0**digits)
    cut = lambda c: F.when(F.abs(F.col(c)) < 1e9, F.round(F.col(c).cast("double") * scale) / scale).otherwise(F.round(F.col(c).cast("double"), digits))
    return df.select(*((cut(c) + F.lit(0.0)).alias(c) if k in ("double", "int", "bigint") else F.col(c).cast("string").alias(c) if k == "date" else F.col(c) for c, k in df.dtypes))


def _block(*blocks: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(build(hourly(spark, sf_dir), CONFIG, blocks).drop("close"))

    return query


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _g(expression: str, x: str, n: int, minp: int | None = None) -> str:
    """A window aggregate once enough of its rows are there."""
    return f"CASE WHEN count({x}) OVER {_w(n)} >= {minp or n} THEN {expression} OVER {_w(n)} END"


def _ema(x: str, n: int, minp: int | None = None, weight: float | None = None) -> str:
    a = weight or 2.0 / (n + 1)
    rows = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return (
        f"CASE WHEN count({x}) OVER {rows} >= {minp or n} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {rows}, "
        f"lambda a, x: (1 - {a!r}::DOUBLE) * a + {a!r}::DOUBLE * x) END"
    )


_O = "(PARTITION BY symbol ORDER BY ts)"
_BASE = f"""WITH {BARS}, p AS (
  SELECT *, row_number() OVER {_O} AS rn, lag(close) OVER {_O} AS c1, lag(high) OVER {_O} AS h1, lag(low) OVER {_O} AS l1 FROM bars
), b AS (
  SELECT *, greatest(high - low, abs(high - coalesce(c1, close)), abs(low - coalesce(c1, close))) AS tr, (high + low + close) / 3.0 AS tp,
    ln(close + 1e-9) AS lc, coalesce(ln(close + 1e-9) - ln(c1 + 1e-9), 0) AS lr, coalesce((close - c1) / (c1 + 1e-9), 0) AS ret,
    greatest(coalesce(close - c1, 0), 0) AS gain, greatest(coalesce(c1 - close, 0), 0) AS loss, abs(close - c1) AS step,
    greatest(coalesce(high - h1, 0), 0) AS u, greatest(coalesce(l1 - low, 0), 0) AS d, volume * close AS nv, (high - low) / (close + 1e-9) AS rp,
    ln(1 + volume) AS lv, (high - greatest(open, close) - (least(open, close) - low)) / (high - low + 1e-9) AS shadow,
    greatest(0, least(1, (least(open, close) - low) / (high - low + 1e-9))) AS wick
  FROM p
)"""


def _sql(columns: dict[str, str], *ctes: str, source: str = "b") -> str:
    last = ",\n  ".join(f"round({x}, 6) + 0.0 AS {name}" for name, x in columns.items())
    return ",\n".join([_BASE, *ctes]) + f"\nSELECT symbol, ts,\n  {last}\nFROM {source}"


def _run(flag: str) -> str:
    return f"rn - coalesce(max(CASE WHEN NOT ({flag}) THEN rn END) OVER (PARTITION BY symbol ORDER BY ts), 0)"


def _since(flag: str) -> str:
    return f"rn - coalesce(max(CASE WHEN {flag} THEN rn END) OVER (PARTITION BY symbol ORDER BY ts), 0)"


def _index(g: str, m: str) -> str:
    return f"100 - 100 / (1 + ({g}) / (({m}) + 1e-9))"


def _slope(n: int) -> str:
    back = f"least({n}, rn - 1)"
    return f"CASE WHEN rn >= {n} AND rn > 1 THEN (lc - coalesce(lag(lc, {n}) OVER {_O}, first_value(lc) OVER {_O})) / nullif({back}, 0) * 100 END"


def _latest(kind: str, n: int) -> str:
    """Rows since the least or greatest close of the frame, the latest of equals."""
    sign = "" if kind == "max" else "-"
    return f"CASE WHEN rn >= {n} THEN rn - arg_max(rn, {{'x': {sign}close, 'r': rn}}) OVER {_w(n)} END"


_SQL = {
    "feature_shitidx": _sql({"shitidx_pct_240_720": f"(({_ema('close', 4)}) - ({_ema('close', 12)})) / (close + 1e-9) * 100"}),
    "feature_atr": _sql({f"atr_pct_{m}": f"{_g('avg(tr)', 'tr', m // 60)} / (close + 1e-9) * 100" for m in (240, 720)}),
    "feature_keltner": _sql(
        {
            "keltner_halfwidth_pct_240": "2 * a4 / (close + 1e-9) * 100", "keltner_center_pct_240": "(e4 - close) / (close + 1e-9) * 100",
            "keltner_center_pct_720": "(e12 - close) / (close + 1e-9) * 100", "keltner_pos_720": "(close - e12 + 2 * a12) / (4 * a12 + 1e-9)",
            "keltner_width_z_240": f"(w - ({_g('avg(w)', 'w', 8, 4)})) / (({_g('stddev_pop(w)', 'w', 8, 4)}) + 1e-9)",
        },
        f"k AS (SELECT *, {_ema('close', 4)} AS e4, {_ema('close', 12)} AS e12, {_g('avg(tr)', 'tr', 4)} AS a4, {_g('avg(tr)', 'tr', 12)} AS a12 FROM b)",
        "z AS (SELECT *, 4 * a4 / (close + 1e-9) * 100 AS w FROM k)", source="z",
    ),
    "feature_rsi": _sql(
        {f"rsi_price_{m}": _index(_g("avg(gain)", "gain", m // 60), _g("avg(loss)", "loss", m // 60)) for m in (240, 720)}
        | {"rsi_ema240_720": _index(_g("avg(g2)", "g2", 12), _g("avg(l2)", "l2", 12))},
        f"e AS (SELECT *, {_ema('close', 4)} AS s FROM b)", f"e2 AS (SELECT *, s - lag(s) OVER {_O} AS ds FROM e)",
        "e3 AS (SELECT *, greatest(coalesce(ds, 0), 0) AS g2, greatest(coalesce(-ds, 0), 0) AS l2 FROM e2)", source="e3",
    ),
    "feature_slope": _sql({f"slope_pct_{m}": _slope(m // 60) for m in (240, 720)}),
    "feature_vol": _sql({f"vol_pct_{m}": f"{_g('stddev_pop(ret)', 'ret', m // 60)} * 100" for m in (240, 1440)}),
    "feature_choppiness": _sql({
        f"ci_{n * 60}": f"CASE WHEN rn >= {n} THEN 100 * log10(sum(step) OVER {_w(n)} / (max(close) OVER {_w(n)} - min(close) OVER {_w(n)} + 1e-9) + 1e-9) / log10({n}) END"
        for n in (4, 12)
    }),
    "feature_cumulative_return": _sql({f"cum_ret_pct_{n * 60}": f"(exp({_g('sum(lr)', 'lr', n)}) - 1) * 100" for n in (4, 12)}),
    "feature_cci": _sql({"cci_720": f"(tp - ({_g('avg(tp)', 'tp', 12)})) / (0.015 * (({_g('stddev_pop(tp)', 'tp', 12)}) * 0.7978845608028654 + 1e-9))"}),
    "feature_adx": _sql(
        {f"adx_{n * 60}": _ema(f"dx{n}", n, n, 1.0 / n) for n in (4, 12)},
        "dm AS (SELECT *, CASE WHEN u >= d THEN u ELSE 0 END AS up, CASE WHEN d > u THEN d ELSE 0 END AS dn FROM b)",
        "di AS (SELECT *, " + ", ".join(f"{_g('sum(up)', 'up', n)} / ({_g('sum(tr)', 'tr', n)} + 1e-9) * 100 AS p{n}, {_g('sum(dn)', 'dn', n)} / ({_g('sum(tr)', 'tr', n)} + 1e-9) * 100 AS m{n}" for n in (4, 12)) + " FROM dm)",
        "dx AS (SELECT *, " + ", ".join(f"abs(p{n} - m{n}) / (p{n} + m{n} + 1e-9) * 100 AS dx{n}" for n in (4, 12)) + " FROM di)", source="dx",
    ),
    "feature_time_since": _sql({
        k: v for n in (4, 24) for k, v in {
            f"pct_from_min_{n * 60}": f"(close - {_g('min(close)', 'close', n)}) / ({_g('min(close)', 'close', n)} + 1e-9) * 100",
            f"pct_from_max_{n * 60}": f"({_g('max(close)', 'close', n)} - close) / ({_g('max(close)', 'close', n)} + 1e-9) * 100",
            f"time_since_min_{n * 60}": _latest("min", n), f"time_since_max_{n * 60}": _latest("max", n),
        }.items()
    }),
    "feature_zlog": _sql({"zlog_720m": f"(lc - ({_g('avg(lc)', 'lc', 12)})) / (({_g('stddev_pop(lc)', 'lc', 12)}) + 1e-9)"}),
    "feature_residual": _sql({
        f"slope_reserr_pct_{n * 60}": f"CASE WHEN rn >= {n} THEN (exp(sqrt(greatest(0, regr_syy(lc, rn) OVER {_w(n)} - (regr_sxy(lc, rn) OVER {_w(n)}) ** 2 / regr_sxx(lc, rn) OVER {_w(n)}) / {n})) - 1) * 100 END"
        for n in (4, 12)
    }),
    "feature_vol_ratio": _sql({"vol_ratio_pct_240_720": f"(({_g('stddev_pop(ret)', 'ret', 4)}) * 100 / (({_g('stddev_pop(ret)', 'ret', 12)}) * 100 + 1e-9) - 1) * 100"}),
    "feature_regime": _sql(
        {"log_volume_ema": f"ln(1 + ({_ema('nv', 24)}))", "liquidity_ratio": f"CASE WHEN rn >= 4 THEN ln(1 + greatest(0, ({_ema('nv', 4)}) / (({_ema('trp', 4)}) + 1e-9))) END"},
        "t AS (SELECT *, tr / (close + 1e-9) AS trp FROM b)", source="t",
    ),
    "feature_liquidity": _sql(
        {"volume_to_range_ema240": _ema("r", 4)}, f"q AS (SELECT *, ln(1 + ({_ema('nv', 2)}) / (({_ema('rp', 2)}) + 1e-9)) AS r FROM b)", source="q"
    ),
    "feature_reversal_speed": _sql({
        k: v for n in (4, 12) for k, v in {
            f"rev_speed_up_{n * 60}": f"(close / ({_g('min(close)', 'close', n)} + 1e-9) - 1) * 100 / ({_latest('min', n)} + 1)",
            f"rev_speed_down_{n * 60}": f"({_g('max(close)', 'close', n)} / (close + 1e-9) - 1) * 100 / ({_latest('max', n)} + 1)",
        }.items()
    }),
    "feature_volume_z": _sql(
        {"vol_z": "z", "signed_vol_z": "z * coalesce(sign(close / (c1 + 1e-9) - 1), 0)"},
        f"v AS (SELECT *, {_ema('lv', 4)} AS s, {_ema('lv', 12)} AS l FROM b)", "v2 AS (SELECT *, abs(lv - l) AS apart FROM v)",
        f"v3 AS (SELECT *, (lv - s) / (({_ema('apart', 12)}) + 1e-9) AS z FROM v2)", source="v3",
    ),
    "feature_shadow": _sql(
        {"shadow_balance_raw": "shadow", "shadow_balance": _ema("sc", 3)}, "s AS (SELECT *, greatest(-1, least(1, shadow)) AS sc FROM b)", source="s"
    ),
    "feature_range_ratio": _sql({"range_ratio_240_720": f"({_g('max(high)', 'high', 4)} - {_g('min(low)', 'low', 4)}) / ({_g('max(high)', 'high', 12)} - {_g('min(low)', 'low', 12)} + 1e-9)"}),
    "feature_efficiency": _sql({
        f"eff_{n * 60}": f"CASE WHEN rn >= {n} THEN CASE WHEN sum(step) OVER {_w(n - 1)} <= 1e-12 THEN 0 ELSE abs(close - first_value(close) OVER {_w(n)}) / sum(step) OVER {_w(n - 1)} END END"
        for n in (4, 12)
    }),
    "feature_runs": _sql({
        **{f"run_{a}_cnt_{n * 60}": f"(sum(CASE WHEN {x} > 0 THEN 1.0 ELSE 0 END) OVER {_w(n)})::DOUBLE" for n in (4, 12) for a, x in (("up", "gain"), ("dn", "loss"))},
        "run_up_len": _run("gain > 0"), "run_dn_len": _run("loss > 0"),
    }),
    "feature_higher_highs": _sql({f"{a}_cnt_240": f"(sum(CASE WHEN {x} THEN 1.0 ELSE 0 END) OVER {_w(4)})::DOUBLE" for a, x in (("hh", "high > h1"), ("hl", "low > l1"))}),
    "feature_ema_cross": _sql(
        {"bars_above_ema_240": _run("coalesce(close > e, false)"), "bars_below_ema_240": _run("coalesce(close < e, false)"), "bars_since_cross_240": _since("turned")},
        f"e AS (SELECT *, {_ema('close', 4)} AS e FROM b)", f"f AS (SELECT *, last_value(nullif(sign(close - e), 0) IGNORE NULLS) OVER {_O} AS side FROM e)",
        f"t AS (SELECT *, coalesce(side <> lag(side) OVER {_O}, false) AS turned FROM f)", source="t",
    ),
    "feature_breakout": _sql(
        {
            k: v for n in (4, 12) for k, v in {
                f"break_high_{n * 60}": f"CASE WHEN o{n} THEN 1.0 ELSE 0 END::DOUBLE", f"break_low_{n * 60}": f"CASE WHEN i{n} THEN 1.0 ELSE 0 END::DOUBLE",
                f"bars_since_bhigh_{n * 60}": _since(f"o{n}"), f"bars_since_blow_{n * 60}": _since(f"i{n}"),
            }.items()
        },
        "m AS (SELECT *, " + ", ".join(f"{_g('max(high)', 'high', n)} AS x{n}, {_g('min(low)', 'low', n)} AS y{n}" for n in (4, 12)) + " FROM b)",
        "o AS (SELECT *, " + ", ".join(f"coalesce(close > lag(x{n}) OVER {_O} + 1e-9, false) AS o{n}, coalesce(close < lag(y{n}) OVER {_O} - 1e-9, false) AS i{n}" for n in (4, 12)) + " FROM m)", source="o",
    ),
    "feature_momentum": _sql({"slope_diff_240_720": f"({_slope(4)}) - ({_slope(12)})"}),
    "feature_wicks": _sql({"wick_lower_streak": _run("wick > 0.5"), "wick_lower_mean_240": f"avg(wick) OVER {_w(4)}"}),
}

_BLOCK_OF = {
    "choppiness": "ci", "cumulative_return": "cum_logret", "residual": "slope_reserr", "reversal_speed": "rev_speed", "volume_z": "vol_z", "efficiency": "eff",
    "higher_highs": "hh_hl", "momentum": "mom_short", "wicks": "wick_stats",
}
for _name, _text in _SQL.items():
    _own = _name.removeprefix("feature_")
    QUERIES[_name], ORACLE_SQL[_name] = _block(_BLOCK_OF.get(_own, _own)), _text


@add(f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def ohlc_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


@add(f"""WITH {BARS}, p AS (SELECT *, row_number() OVER {_O} AS rn, coalesce((close - lag(close) OVER {_O}) / (lag(close) OVER {_O} + 1e-9), 0) AS ret FROM bars)
SELECT symbol, ts, round({_g('avg(close)', 'close', 5)}, 6) AS sma_5, round({_g('stddev_pop(ret)', 'ret', 5)}, 6) AS vol_5 FROM p""")
def sma_vol_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barquill.functions import rolling as R

    rows = B.segments(hourly(spark, sf_dir))
    rows = rows.withColumn("ret", F.coalesce((F.col("close") - R.before("close")) / (R.before("close") + R.EPS), F.lit(0.0)))
    return rows.select("symbol", "ts", F.round(R.mean("close", 5), 6).alias("sma_5"), F.round(R.deviation("ret", 5), 6).alias("vol_5"))


@add(f"""WITH {BARS} SELECT symbol, date_trunc('day', ts) + INTERVAL 4 HOUR * (hour(ts) // 4) AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
  min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, false AS gap_after FROM bars GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY symbol, date_trunc('day', ts) + INTERVAL 4 HOUR * (hour(ts) // 4)"))
def resample_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(hourly(spark, sf_dir), 4 * 3600)


_GRID = f"""WITH {BARS}, ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends),
j AS (SELECT g.symbol, g.ts, open, high, low, bars.close AS c, volume, bars.close IS NULL AS missing FROM g LEFT JOIN bars USING (symbol, ts)),
k AS (SELECT *, last_value(c IGNORE NULLS) OVER {_O} AS close, sum(ch) OVER {_O} AS st FROM (
  SELECT *, CASE WHEN missing IS DISTINCT FROM lag(missing) OVER {_O} THEN 1 ELSE 0 END AS ch FROM j) x),
l AS (SELECT *, missing AND count(*) OVER (PARTITION BY symbol, st) > 1 AS far FROM k)"""


@add(_GRID + f"""
SELECT symbol, ts, CASE WHEN missing AND NOT far THEN close ELSE open END AS open, CASE WHEN missing AND NOT far THEN close ELSE high END AS high,
  CASE WHEN missing AND NOT far THEN close ELSE low END AS low, close, coalesce(volume, 0) AS volume, missing,
  NOT missing AND coalesce(lead(far) OVER {_O}, false) AS gap_after FROM l""")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fill_gaps(hourly(spark, sf_dir), 3600, 3600)


@add(_GRID + f""", s AS (SELECT *, NOT missing AS ok, lag(NOT missing, 1, false) OVER {_O} AS ok1 FROM l),
t AS (SELECT *, sum(CASE WHEN ok <> ok1 THEN 1 ELSE 0 END) OVER {_O} AS seg FROM s)
SELECT symbol, ts, seg::BIGINT AS seg, row_number() OVER (PARTITION BY symbol, seg ORDER BY ts)::INTEGER AS rn FROM t WHERE ok""")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.segments(B.grid(hourly(spark, sf_dir), 3600)).select("symbol", "ts", "seg", "rn")


@add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT event_type AS symbol, date_trunc('minute', ts) AS minute, event_id AS tick_id, value AS price FROM r WHERE k = 1""")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return B.keep_last(rows, ["symbol", "minute"], ["ts", "tick_id"]).select("symbol", "minute", "tick_id", "price")


@add(f"""WITH {BARS}, last AS (SELECT symbol, max(ts) AS hi FROM bars GROUP BY 1)
SELECT symbol, ts, close FROM bars JOIN last USING (symbol) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < hi - INTERVAL 3 DAY""")
def range_scan_tail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scan(hourly(spark, sf_dir), start="2024-01-05 00:00:00", tail_days=3, columns=["symbol", "ts", "close", "absent"])


@add(f"WITH {BARS}, r AS (SELECT *, row_number() OVER {_O} AS k FROM bars) SELECT symbol, ts, close FROM r WHERE (k - 1) % 7 = 0")
def stride_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stride(hourly(spark, sf_dir), 7).select("symbol", "ts", "close")


@add(f"""WITH {BARS}, r AS (SELECT *, row_number() OVER {_O} AS k, coalesce(date_diff('second', lag(ts) OVER {_O}, ts) >= 7200, false) AS late FROM bars)
SELECT symbol, ts, (min(CASE WHEN late THEN k END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - k)::INTEGER AS gap_in FROM r""")
def next_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.next_gap(hourly(spark, sf_dir), 2).select("symbol", "ts", "gap_in")


@add("""WITH e AS (SELECT event_type AS symbol, ts, round(value / 50) AS v, event_id FROM events),
r AS (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS v1 FROM e) SELECT symbol, count(*) AS n, count_if(coalesce(v = v1, false))::BIGINT AS frozen FROM r GROUP BY 1""")
def frozen_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("price") / 50)
    rows = ticks(spark, sf_dir).select("symbol", F.struct("ts", "tick_id").alias("ts"), *(v.alias(c) for c in ("open", "high", "low", "close")))
    return B.frozen(rows).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("frozen").alias("frozen"))


@add(f"WITH {BARS}, r AS (SELECT symbol, date_diff('second', ts, lead(ts) OVER {_O}) AS s FROM bars) SELECT symbol, min(s)::BIGINT AS candle_seconds FROM r GROUP BY 1")
def candle_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.candle_seconds(hourly(spark, sf_dir))


@add(f"""WITH {BARS}, e AS (SELECT symbol, epoch(min(ts)) AS lo, epoch(max(ts)) AS hi, count(*) AS n FROM bars GROUP BY 1),
r AS (SELECT symbol, n, greatest(0, (least(hi, epoch(TIMESTAMP '2024-01-25')) - greatest(lo, epoch(TIMESTAMP '2024-01-03'))) / 3600 + 1) * n / ((hi - lo) / 3600 + 1) AS rows FROM e)
SELECT symbol, n, round(rows, 6) AS rows, CASE WHEN rows >= 500 THEN 'use' WHEN rows < 480 THEN 'skip' ELSE 'load' END AS decision FROM r""")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage(hourly(spark, sf_dir), 3600, "2024-01-03 00:00:00", "2024-01-25 00:00:00", use=500, skip=480)
