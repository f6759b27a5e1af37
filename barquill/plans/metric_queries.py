"""Metrics as queries: orders by priority as portfolios' daily returns, line items as trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.operators import metrics as M
from barquill.plans.feature_queries import _rounded
from barquill.plans.fixtures import BARS, hourly, table
from barquill.plans.registry import add


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"))
    return days.agg(F.round((F.avg("o_totalprice") / 250000 - 1) / 50, 6).alias("r"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_returnflag").alias("key"), F.concat(F.lit("S"), (F.col("l_suppkey") % 16).cast("string")).alias("symbol"), F.col("l_shipdate").alias("exit_ts"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("entry_ts"), F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("r_net"), (F.col("l_quantity") / 5000).alias("weight"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


_R = """WITH ret AS (SELECT o_orderpriority AS key, o_orderdate::DATE AS day, round((avg(o_totalprice) / 250000 - 1) / 50, 6) AS r FROM orders GROUP BY 1, 2),
eq AS (SELECT key, day, exp(sum(ln(1 + r)) OVER (PARTITION BY key ORDER BY day)) AS equity FROM ret)"""
_T = """WITH t AS (SELECT l_returnflag AS key, 'S' || (l_suppkey % 16)::VARCHAR AS symbol, l_shipdate AS exit_ts, date_trunc('month', l_shipdate) AS entry_ts, round(l_discount - l_tax, 4) AS r_net,
  l_quantity / 5000 AS weight, round(l_discount - l_tax, 4) * (l_quantity / 5000) AS w, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)"""
_D = "(PARTITION BY key ORDER BY day)"


@add(_R + " SELECT key, day::VARCHAR AS day, round(equity, 6) AS equity FROM eq")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.curve(returns(spark, sf_dir)))


@add(_R + f""", p AS (SELECT *, max(equity) OVER {_D} AS peak, row_number() OVER {_D} AS n FROM eq), d AS (SELECT *, (peak - equity) / peak AS dd, n - coalesce(max(CASE WHEN equity >= peak THEN n END) OVER {_D}, 0) AS run FROM p)
SELECT key, round(max(dd), 6) AS max_drawdown, round(sqrt(avg(dd * dd)), 6) AS ulcer_index, round(max(run) / count(*), 6) AS longest_drawdown, round(avg((equity < peak)::INT), 6) AS underwater_frac FROM d GROUP BY 1""")
def equity_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.drawdowns(M.curve(returns(spark, sf_dir))))


def _periods(bucket: str) -> str:
    return _R + f""", m AS (SELECT key, {bucket} AS period, max_by(equity, day) AS e FROM eq GROUP BY 1, 2), r AS (SELECT *, e / lag(e) OVER (PARTITION BY key ORDER BY period) - 1 AS pr FROM m)"""


_STATS = "SELECT key, round(avg(pr), 6) AS {0}_mean, round(quantile_cont(pr, 0.5), 6) AS {0}_p50, round(avg((pr > 0)::INT), 6) AS {0}_pos_frac, round(min(pr), 6) AS {0}_worst, round(max(pr), 6) AS {0}_best FROM r WHERE pr IS NOT NULL GROUP BY 1"


@add(_periods("date_trunc('month', day)") + " " + _STATS.format("month"))
def equity_month_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.period_stats(M.period_returns(M.curve(returns(spark, sf_dir)), 1), "month"))


@add(_periods("make_date(year(day), (((month(day) - 1) // 6) * 6 + 1)::BIGINT, 1)") + " " + _STATS.format("semester"))
def equity_semester_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.period_stats(M.period_returns(M.curve(returns(spark, sf_dir)), 6), "semester"))


@add(_R + " SELECT key, date_trunc('month', day)::DATE::VARCHAR AS period, round(max_by(equity, day) / min_by(equity, day) - 1, 6) AS r FROM eq GROUP BY 1, 2")
def equity_within_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.within_month_returns(M.curve(returns(spark, sf_dir))))


@add(_periods("date_trunc('month', day)") + """, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY period) AS n FROM r WHERE pr IS NOT NULL),
s AS (SELECT *, n - coalesce(max(CASE WHEN pr >= 0 THEN n END) OVER (PARTITION BY key ORDER BY period), 0) AS run FROM n) SELECT key, max(run)::DOUBLE AS max_neg_month_streak FROM s GROUP BY 1""")
def equity_losing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.losing_streak(M.period_returns(M.curve(returns(spark, sf_dir)), 1)))


@add(_R + f""", s AS (SELECT *, equity / lag(equity) OVER {_D} - 1 AS r1, equity / lag(equity, 14) OVER {_D} - 1 AS r14, equity / lag(equity, 30) OVER {_D} - 1 AS r30, equity / lag(equity, 90) OVER {_D} - 1 AS r90 FROM eq),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r1 NULLS LAST, day) AS k FROM s)
SELECT key, round(min(r1), 6) AS worst_day, round(min(r14), 6) AS worst_14d, round(min(r30), 6) AS worst_30d, round(min(r90), 6) AS worst_90d, round(sum(r1) FILTER (WHERE k <= 5), 6) AS sum5_worst_days FROM k GROUP BY 1""")
def equity_worst_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.worst_stretches(M.curve(returns(spark, sf_dir))))


@add(_T + """ SELECT key, count(*)::DOUBLE AS trades, round(avg((r_net > 0)::INT), 6) AS win_rate, round(sum(r_net) FILTER (WHERE r_net > 0) / -sum(r_net) FILTER (WHERE r_net < 0), 6) AS profit_factor,
  round(sum(w) FILTER (WHERE w > 0) / -sum(w) FILTER (WHERE w < 0), 6) AS profit_factor_weighted, round(quantile_cont(r_net, 0.25), 6) AS r_p25, round(quantile_cont(r_net, 0.5), 6) AS r_p50, round(quantile_cont(r_net, 0.75), 6) AS r_p75,
  round(avg(r_net) FILTER (WHERE r_net > 0), 6) AS mean_win, round(-avg(r_net) FILTER (WHERE r_net < 0), 6) AS mean_loss, round(avg(r_net) FILTER (WHERE r_net > 0) / -avg(r_net) FILTER (WHERE r_net < 0), 6) AS payoff,
  round(avg(r_net), 6) AS expectancy, round(min(w), 6) AS worst_trade, round(min(r_net), 6) AS worst_trade_raw, round(sum(w), 6) AS ret_weighted FROM t GROUP BY 1""")
def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.trade_stats(trades(spark, sf_dir)))


@add(_T + """, o AS (SELECT l_orderkey AS key, r_net, row_number() OVER (PARTITION BY l_orderkey ORDER BY r_net DESC) AS k FROM t)
SELECT key, round(product(1 + r_net) - 1, 12) AS ret, round(coalesce(product(1 + r_net) FILTER (WHERE k > 1), 1) - 1, 12) AS ret_wo_best, round(coalesce(product(1 + r_net) FILTER (WHERE k > 3), 1) - 1, 12) AS ret_wo_top FROM o GROUP BY 1""")
def trades_without_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of each order compounded, with and without the best."""
    return _rounded(M.compounded_without_best(trades(spark, sf_dir).withColumn("key", F.col("l_orderkey"))), 12)


@add(_T + """, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC) AS k FROM t)
SELECT key, round(max(w) / sum(w) FILTER (WHERE w > 0), 6) AS top1_share_pos, round(sum(w) FILTER (WHERE k <= 3) / sum(w) FILTER (WHERE w > 0), 6) AS top3_share_pos,
  round(sum(w) - max(w), 6) AS ret_wo_best, round(sum(w) - sum(w) FILTER (WHERE k <= 3), 6) AS ret_wo_top3 FROM k GROUP BY 1""")
def trade_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.concentration(trades(spark, sf_dir)))


@add(_T + ", c AS (SELECT key, entry_ts, count(*) AS n FROM t GROUP BY 1, 2) SELECT key, count(*)::DOUBLE AS clusters, round(avg(n), 6) AS avg_trades_per_cluster FROM c GROUP BY 1")
def trade_entry_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.entry_clusters(trades(spark, sf_dir)))


@add(_T + """ SELECT symbol, count(*)::DOUBLE AS trades, round(sum(w), 6) AS pnl, round(sum(w) FILTER (WHERE w > 0), 6) AS gains, round(sum(w) FILTER (WHERE w < 0), 6) AS losses, round(avg((w > 0)::INT), 6) AS win_rate,
  round(sum(ln(1 + w)), 6) AS log_return, round(sum(w) FILTER (WHERE w > 0) / -sum(w) FILTER (WHERE w < 0), 6) AS profit_factor FROM t GROUP BY 1""")
def symbol_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.symbol_contribution(trades(spark, sf_dir)))


_ORD = ["exit_ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
_W = f"(PARTITION BY symbol ORDER BY {', '.join(_ORD)} ROWS UNBOUNDED PRECEDING)"


@add(_T + f""", e AS (SELECT *, exp(sum(ln(1 + w)) OVER {_W}) AS equity FROM t), p AS (SELECT *, greatest(1, max(equity) OVER {_W}) AS peak FROM e), d AS (SELECT *, max(1 - equity / peak) OVER {_W} AS dd FROM p)
SELECT symbol, round(max(dd), 6) AS max_drawdown, round(max_by(equity, row(exit_ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)), 6) AS eq_end FROM d GROUP BY 1""")
def symbol_trade_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.trade_curve(trades(spark, sf_dir), _ORD)
    return _rounded(rows.groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"), F.max_by("equity", F.struct(*_ORD)).alias("eq_end")))


@add("""WITH ret AS (SELECT o_orderpriority AS step, o_orderdate::DATE AS day, round((avg(o_totalprice) / 250000 - 1) / 50, 6) AS r FROM orders GROUP BY 1, 2), f AS (SELECT day, min_by(r, step) AS r FROM ret GROUP BY 1)
SELECT 'all' AS key, day::VARCHAR AS day, round(exp(sum(ln(1 + r)) OVER (ORDER BY day)), 6) AS equity FROM f""")
def stitched_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.stitch(returns(spark, sf_dir).withColumnRenamed("key", "step")))


@add("""WITH e AS (SELECT event_type AS key, ts::DATE AS day, max_by(value, row(ts, event_id)) AS equity FROM events GROUP BY 1, 2),
g AS (SELECT key, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY key)
SELECT key, day::VARCHAR AS day, round(last_value(equity IGNORE NULLS) OVER (PARTITION BY key ORDER BY g.day), 6) AS equity FROM g LEFT JOIN e USING (key, day)""")
def daily_equity_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return _rounded(M.daily_curve(rows.select(F.col("event_type").alias("key"), "ts", F.col("value").alias("equity"))))


@add(_T + " SELECT symbol, round(sum(r_net * weight) / sum(weight), 6) AS r_net FROM t GROUP BY 1")
def weighted_mean_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.weighted_mean(trades(spark, sf_dir), ["symbol"], "r_net", "weight"))


@add(f"""WITH {BARS}, w AS (SELECT symbol, ts, max(high) OVER x AS h, min(low) OVER x AS l FROM bars WINDOW x AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round((h - l) / l * 100, 6) AS range_24h_pct FROM w""")
def time_range_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.time_range(hourly(spark, sf_dir), 24).select("symbol", "ts", "range_24h_pct"))


@add(f"""WITH {BARS}, p AS (SELECT symbol, max_by(close, ts) AS price, min_by(open, ts) AS entry_price, count(*)::DOUBLE AS qty FROM bars GROUP BY 1)
SELECT symbol, round(qty * price, 6) AS value, round(qty * (price - entry_price), 6) AS unrealized, round(qty * price / sum(qty * price) OVER (), 6) AS allocation FROM p""")
def position_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    held = bars.groupBy("symbol").agg(F.min_by("open", "ts").alias("entry_price"), F.count("*").cast("double").alias("qty"))
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return _rounded(M.position_pnl(held, last).select("symbol", "value", "unrealized", "allocation"))


@add(_T + """, s AS (SELECT key, symbol, round(sum(w), 9) AS pnl FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pnl DESC, symbol) AS k FROM s)
SELECT key, string_agg(symbol, ',' ORDER BY k) AS top_symbols FROM k WHERE k <= 10 GROUP BY 1""")
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_symbols(trades(spark, sf_dir), 10)
