"""Views for training, filters, summaries of steps, seeds for refinement, symbols, log tails and live state as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.functions.tables import new_path
from barquill.operators import features as E
from barquill.operators import labels as L
from barquill.operators import sampling as D
from barquill.operators import scoring as C
from barquill.operators import search as P
from barquill.operators import select as S
from barquill.operators import universe as U
from barquill.plans.feature_queries import _rounded
from barquill.plans.fixtures import BARS, hourly, table
from barquill.plans.registry import add
from barquill.plans.selection_queries import _L, labelled
from barquill.plans.simulation_queries import _events
from barquill.sources import files as W
from barquill.streaming import live
from barquill.streaming.state import run_stateful, stateful

_HOURS = "(epoch(ts) / 3600)::BIGINT"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a label that is missing each third hour, an exit target that is 0 each fifth, and a wait of up to 3 bars."""
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    label = F.when(hours % 3 != 0, (hours % 7 < 3).cast("double"))
    return hourly(spark, sf_dir).withColumns({"entry_label": label, "exit_wait": (hours % 4).cast("int"), "span_q50": (hours % 5).cast("double"), "span_weight": F.when(hours % 2 == 0, (hours % 11) / 2)})


_T = f"""WITH {BARS}, t AS (SELECT symbol, ts, close, CASE WHEN {_HOURS} % 3 <> 0 THEN ({_HOURS} % 7 < 3)::INT::DOUBLE END AS entry_label, ({_HOURS} % 4)::INT AS exit_wait,
  ({_HOURS} % 5)::DOUBLE AS span_q50, CASE WHEN {_HOURS} % 2 = 0 THEN ({_HOURS} % 11) / 2 END AS span_weight FROM bars)"""
_CYCLE = "0 AS cycle_is_add, 0 AS cycle_num_adds, 0 AS cycle_time_in_trade, 0.0::DOUBLE AS cycle_dd_pct, close AS cycle_avg_entry_price, close AS cycle_last_fill_price"
_CYCLE_COLUMNS = ["cycle_is_add", "cycle_num_adds", "cycle_time_in_trade", "cycle_dd_pct", "cycle_avg_entry_price", "cycle_last_fill_price"]


@add(_T + f" SELECT symbol, ts, {_CYCLE}, entry_label::FLOAT AS label_entry FROM t WHERE entry_label IS NOT NULL")
def entry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.entry_view(_targets(spark, sf_dir)).select("symbol", "ts", *_CYCLE_COLUMNS, "label_entry")


@add(_T + f" SELECT symbol, ts, {_CYCLE}, span_q50::FLOAT AS label_exit, greatest(1, coalesce(span_weight, 1))::FLOAT AS label_exit_weight FROM t WHERE span_q50 > 0")
def exit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exit_view(_targets(spark, sf_dir)).select("symbol", "ts", *_CYCLE_COLUMNS, "label_exit", "label_exit_weight")


@add(_T + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM t), c AS (SELECT DISTINCT symbol, unnest(range(n, n + exit_wait + 1)) AS n FROM n WHERE entry_label >= 0.5)
SELECT n.symbol, n.ts, true AS mask_all, coalesce(entry_label >= 0.5, false) AS mask_entry, c.n IS NOT NULL AS mask_trade FROM n LEFT JOIN c ON c.symbol = n.symbol AND c.n = n.n""")
def exit_mask_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    for mode in ("all", "entry", "trade"):
        rows = L.exit_mask(rows, mode).withColumnRenamed("exit_mask", f"mask_{mode}")
    return rows.select("symbol", "ts", "mask_all", "mask_entry", "mask_trade")


@add(_L + """, f AS (SELECT * FROM e WHERE CASE WHEN label >= 0.5 THEN weight >= 1.5 ELSE weight >= 0.4 END), n AS (SELECT greatest(1, round(count(*) * 0.6)) AS q FROM f WHERE label >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k FROM f) SELECT event_id, label, weight FROM r, n WHERE label < 0.5 OR k <= q""")
def sample_least_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.least_weight(labelled(spark, sf_dir), F.col("event_id"), 1.5, 0.4, 0.6).select("event_id", "label", "weight")


@add(_L + """, b AS (SELECT *, floor(weight / 0.1 + 1e-9)::BIGINT AS bin FROM e), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1), m AS (SELECT (count(*) * 9 // 10) AS m FROM e),
s AS (SELECT *, (1 + 1.25::DOUBLE * (bin - min(bin) OVER ()) / greatest(max(bin) OVER () - min(bin) OVER (), 1)) * pow(n, 0.75) AS share FROM c), x AS (SELECT *, m::DOUBLE * share / sum(share) OVER () AS exact FROM s, m),
y AS (SELECT *, floor(exact) AS base, m - sum(floor(exact)) OVER () AS left_over FROM x), z AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, bin) AS k FROM y),
q AS (SELECT bin, n, least(n, base + (k <= left_over)::INT) AS quota, m FROM z),
t AS (SELECT *, m - sum(quota) OVER () AS short, coalesce(sum(n - quota) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM q)
SELECT bin, n, (quota + greatest(0, least(n - quota, short - above)))::BIGINT AS quota FROM t""")
def sample_bins_topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of bins for nine tenths of all rows, so that many bins are too small for theirs."""
    rows = labelled(spark, sf_dir)
    most = rows.count() * 9 // 10
    counts = rows.groupBy(F.floor(F.col("weight") / 0.1 + 1e-9).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return D.topped_up(D.bin_quotas(counts, most), most).select("bin", "n", F.col("quota").cast("long").alias("quota"))


@add(_L + """, s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE score END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value / 100, 6) END AS b FROM e)
SELECT event_id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END, 6) AS merged, coalesce(b, 0) AS sound FROM s""")
def merged_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two sides, of which one may be no number and the other missing; and a feature made sound for scoring."""
    nan = F.lit(float("nan"))
    rows = labelled(spark, sf_dir).withColumn("a", F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.col("score"))).withColumn("b", F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") / 100, 6)))
    return rows.select("event_id", F.round(C.merged_sides(F.col("a"), F.col("b")), 6).alias("merged"), C.sound(F.col("b")).alias("sound"))


# ---- parts as a run log: three steps of backtests, some of them failed, in two phases and five generations

_P = """WITH l AS (SELECT p_partkey AS id, p_partkey AS line, p_size % 3 * 180 AS step, CASE WHEN p_size % 4 = 0 THEN 'train' ELSE 'backtest' END AS stage, CASE WHEN p_size % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'refine' ELSE 'broad' END AS phase, CASE WHEN p_size % 6 > 0 THEN p_size % 6 END::INT AS generation, round(p_retailprice / 100, 4) AS score,
  round((p_partkey * 37 % 101) / 100, 4) AS ret_pct, round((p_partkey * 53 % 97) / 300, 4) AS max_dd, CASE WHEN p_partkey % 9 > 0 THEN round((p_partkey * 17 % 83) / 83, 4) END AS win_rate,
  p_partkey % 10 AS label_id, p_partkey % 7 AS model_id, (p_partkey * 31 % 211) / 211 AS a, (p_partkey * 67 % 197) / 197 AS b FROM part)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), k.alias("line"), (z % 3 * 180).alias("step"), F.when(z % 4 == 0, "train").otherwise("backtest").alias("stage"), F.when(z % 7 == 0, "error").otherwise("ok").alias("status"),
        F.when(z % 5 == 0, None).when(z % 2 == 0, "refine").otherwise("broad").alias("phase"), F.when(z % 6 > 0, z % 6).cast("int").alias("generation"), F.round(F.col("p_retailprice") / 100, 4).alias("score"),
        F.round((k * 37 % 101) / 100, 4).alias("ret_pct"), F.round((k * 53 % 97) / 300, 4).alias("max_dd"), F.when(k % 9 > 0, F.round((k * 17 % 83) / 83, 4)).alias("win_rate"),
        (k % 10).alias("label_id"), (k % 7).alias("model_id"), ((k * 31 % 211) / 211).alias("a"), ((k * 67 % 197) / 197).alias("b"),
    )


@add(_P + """, o AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, id) AS k FROM l WHERE stage = 'backtest' AND status = 'ok')
SELECT step, round(max(CASE WHEN k = 1 THEN score END), 2) AS best_score, round(max(CASE WHEN k = 1 THEN ret_pct END) * 100, 1) AS best_ret, round(max(CASE WHEN k = 1 THEN max_dd END) * 100, 1) AS best_dd,
  round(max(CASE WHEN k = 1 THEN coalesce(win_rate, 0) END) * 100, 1) AS best_wr, count(*)::BIGINT AS total_ok, count(*) FILTER (WHERE coalesce(phase, 'broad') = 'broad')::BIGINT AS broad_ok,
  count(*) FILTER (WHERE phase = 'refine')::BIGINT AS refine_ok, max(coalesce(generation, 1)) AS latest_generation FROM o GROUP BY 1""")
def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.step_summary(run_log(spark, sf_dir))


@add(_P + ", o AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, id) AS k FROM l WHERE stage = 'backtest' AND status = 'ok') SELECT step, id, score FROM o WHERE k <= 100")
def step_top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_runs(run_log(spark, sf_dir)).select("step", "id", "score")


@add(_P + """, s AS (SELECT s_suppkey AS segment, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 4 * 180 END AS source_step, s_suppkey % 10 AS label_id, s_suppkey % 7 AS model_id FROM supplier),
f AS (SELECT step, label_id, model_id, min(line) AS line FROM l GROUP BY 1, 2, 3)
SELECT segment, source_step, f.line, l.score FROM s JOIN f ON f.step = s.source_step AND f.label_id = s.label_id AND f.model_id = s.model_id JOIN l ON l.line = f.line""")
def selected_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    segments = table(spark, sf_dir, "supplier").select(k.alias("segment"), F.when(k % 6 > 0, k % 4 * 180).alias("source_step"), (k % 10).alias("label_id"), (k % 7).alias("model_id"))
    return S.selected_rows(segments, run_log(spark, sf_dir), ["label_id", "model_id"]).select("segment", "source_step", "line", "score")


@add(_P.replace("WITH l AS", "WITH RECURSIVE l AS") + """, o AS (SELECT * FROM l WHERE stage = 'backtest' AND status = 'ok' AND coalesce(generation, 0) < 3),
x AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS xa, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS xb FROM o),
e AS (SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON p.id <> q.id WHERE sqrt((p.xa - q.xa) ** 2 + (p.xb - q.xb) ** 2) <= 0.04),
reach AS (SELECT id AS a, id AS b FROM x UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
g AS (SELECT x.*, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM x JOIN c USING (id)), m AS (SELECT cluster_id, quantile_cont(xa, 0.5) AS ma, quantile_cont(xb, 0.5) AS mb FROM g GROUP BY 1),
d AS (SELECT g.*, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, sqrt((xa - ma) ** 2 + (xb - mb) ** 2), id) AS k FROM g JOIN m USING (cluster_id)),
s AS (SELECT cluster_id, count(*) AS size, quantile_cont(score, 0.25) AS q, quantile_cont(coalesce(max_dd, 1), 0.5) AS dd FROM g GROUP BY 1),
r AS (SELECT *, (rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2) / count(*) OVER () * 0.55 + (rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2) / count(*) OVER () * 0.25
  + (rank() OVER (ORDER BY dd DESC) + (count(*) OVER (PARTITION BY dd) - 1) / 2) / count(*) OVER () * 0.2 AS cs FROM s), t AS (SELECT * FROM r ORDER BY cs DESC, q DESC, size DESC, cluster_id LIMIT 6)
SELECT t.cluster_id::BIGINT AS cluster_id, round(cs, 9) AS cluster_score, size::BIGINT AS size, id, score FROM t JOIN d USING (cluster_id) WHERE d.k = 1""")
def refine_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.refine_seeds(run_log(spark, sf_dir), ["a", "b"], 3, 0.04)
    return found.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.round("cluster_score", 9).alias("cluster_score"), "size", "id", "score")


@add("""WITH r AS (SELECT l_suppkey AS config, l_discount AS fitness, 1 + l_tax AS eq_end, l_tax AS max_dd, l_quantity / 10 AS profit_factor, l_discount * 5 AS win_rate, l_linenumber AS trades, l_linenumber % 3 AS neg_months, l_tax * 2 AS neg_month_ratio FROM lineitem)
SELECT config, round(avg(fitness), 12) AS fitness, round(avg(eq_end), 12) AS eq_end, round(avg(max_dd), 12) AS max_dd, round(avg(profit_factor), 12) AS profit_factor, round(avg(win_rate), 12) AS win_rate, round(avg(neg_month_ratio), 12) AS neg_month_ratio,
  trunc(avg(trades))::DOUBLE AS trades, trunc(avg(neg_months))::DOUBLE AS neg_months, count(*)::DOUBLE AS symbols, sum(trades)::DOUBLE AS trades_total, round(avg(trades), 12) AS trades_avg FROM r GROUP BY 1""")
def averaged_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("config"), c("l_discount").alias("fitness"), (1 + c("l_tax")).alias("eq_end"), c("l_tax").alias("max_dd"), (c("l_quantity") / 10).alias("profit_factor"), (c("l_discount") * 5).alias("win_rate"),
        c("l_linenumber").alias("trades"), (c("l_linenumber") % 3).alias("neg_months"), (c("l_tax") * 2).alias("neg_month_ratio"),
    )
    done = P.averaged(rows, "config")
    return done.select("config", *(F.round(x, 12).alias(x) for x in ("fitness", "eq_end", "max_dd", "profit_factor", "win_rate", "neg_month_ratio")), *(c(x).cast("double").alias(x) for x in ("trades", "neg_months", "symbols", "trades_total")), F.round("trades_avg", 12).alias("trades_avg"))


@add("""WITH s AS (SELECT c_custkey, upper(CASE c_nationkey % 5 WHEN 0 THEN 'usdc' WHEN 1 THEN 'BTCUSDT' WHEN 2 THEN 'DAIUSDT' WHEN 3 THEN 'eurusdt' ELSE c_mktsegment END) AS symbol FROM customer)
SELECT c_custkey, symbol, regexp_full_match(symbol, '(USDC|USDT|BUSD|TUSD|FDUSD|DAI|USDP|EUR|GBP|USD1|USDE)(USDT|USDC)?') AS stable FROM s""")
def stable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 5
    symbol = F.when(k == 0, "usdc").when(k == 1, "BTCUSDT").when(k == 2, "DAIUSDT").when(k == 3, "eurusdt").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(symbol).alias("symbol"), U.is_stable(symbol).alias("stable"))


@add(f"""WITH {BARS}, f AS (SELECT symbol, ts, close, close / 7 AS atr_pct_60, CASE WHEN hour(ts) > 3 THEN volume * 9000 END AS time_since_60, -(close / 3.17::DOUBLE + 1.001::DOUBLE) AS cci_60, volume / 7 AS other FROM bars)
SELECT symbol, ts, round(round(atr_pct_60, 4)::FLOAT::DOUBLE, 4) AS atr_pct_60, greatest(0, least(65535, coalesce(trunc(time_since_60), 0)))::INTEGER AS time_since_60, round(round(cci_60, 1)::FLOAT::DOUBLE, 1) AS cci_60, round(round(other, 6)::FLOAT::DOUBLE, 5) AS other FROM f""")
def compact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir).select("symbol", "ts", "close", (F.col("close") / 7).alias("atr_pct_60"), F.when(F.hour("ts") > 3, F.col("volume") * 9000).alias("time_since_60"), (-(F.col("close") / 3.17 + 1.001)).alias("cci_60"), (F.col("volume") / 7).alias("other"))
    done = E.compact(rows)
    return done.select("symbol", "ts", *(F.round(F.col(c).cast("double"), d).alias(c) for c, d in (("atr_pct_60", 4), ("cci_60", 1), ("other", 5))), "time_since_60")


@add("""WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"ts_utc": "' || event_id || '", "v": 1}' WHEN 1 THEN 'no json' WHEN 2 THEN '{"v": 2}' ELSE '  {"ts_utc": "' || event_id || '"} ' END AS line FROM events)
SELECT trim(line) AS record FROM l WHERE event_id % 4 IN (0, 3) ORDER BY event_id DESC LIMIT 300""")
def monitor_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "monitor")
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit('{"ts_utc": "'), i, F.lit('", "v": 1}'))).when(k == 1, "no json").when(k == 2, '{"v": 2}').otherwise(F.concat(F.lit('  {"ts_utc": "'), i, F.lit('"} ')))
    table(spark, sf_dir, "events").orderBy("event_id").coalesce(1).select(line.alias("value")).write.text(path)
    return W.log_tail(spark, path).select("record")


# ---- live state

_EV = "WITH v AS (SELECT event_type AS symbol, ts, value AS close, event_id FROM events)"


@add("""WITH g AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(value) AS close FROM events GROUP BY event_type, date_trunc('hour', ts)),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS gap FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)), t AS (SELECT *, sum(gap) OVER (PARTITION BY symbol ORDER BY ts) AS seg FROM s),
r AS (SELECT *, count(*) OVER (PARTITION BY symbol, seg ORDER BY ts) AS n FROM t), f AS (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd, min(close) OVER w AS lo, max(close) OVER w AS hi, lag(close) OVER (PARTITION BY symbol, seg ORDER BY ts) AS p FROM r
  WINDOW w AS (PARTITION BY symbol, seg ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, least(n, 50)::DOUBLE AS kept, gap = 1 AS reload, CASE WHEN n >= 4 THEN round(close / p - 1, 6) END AS ret_1, CASE WHEN n >= 4 THEN round(m, 6) END AS mean, CASE WHEN n >= 4 THEN round(sd / m, 6) END AS spread,
  CASE WHEN n >= 4 THEN round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END, 6) END AS place FROM f""")
def stream_latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every newest bar from the state of a stream of hourly bars, four of which it takes to be ready."""
    path = new_path(spark, "bars")
    bars = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("close"))
    bars.write.parquet(path)
    work = live.latest_features(live.read_bars(spark, path, bars.schema), size=50, n=6, ready=4, step_seconds=3600)
    return _rounded(run_stateful(stateful(work), new_path(spark, "stream-features")).select("symbol", "ts", F.col("kept").cast("double").alias("kept"), "reload", "ret_1", "mean", "spread", "place"))


@add(f"""WITH {BARS}, o AS (SELECT symbol, ts, close, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) > INTERVAL 1 HOUR AS gap, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, avg(close) OVER w AS m, min(ts) OVER w AS lo FROM bars
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT symbol, ts, least(n, 24)::DOUBLE AS bars, lo AS first, round(m, 6) AS mean FROM o WHERE gap""")
def reload_after_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 stored bars at each bar that follows a gap."""
    from pyspark.sql import Window

    bars = hourly(spark, sf_dir).select("symbol", "ts", "close")
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    gaps = bars.withColumn("p", before).where(F.col("ts") - F.col("p") > F.expr("INTERVAL 1 HOUR"))
    rows = live.reloaded(gaps, bars, 24)
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x["close"]) / F.size("window")
    return _rounded(rows.select("symbol", "ts", F.size("window").cast("double").alias("bars"), F.col("window")[0]["ts"].alias("first"), mean.alias("mean")))


@add(_EV + """, p AS (SELECT symbol, ts, event_id, CASE WHEN event_id % 3 > 0 THEN close END AS e, CASE WHEN event_id % 5 = 0 THEN 'hold ' || event_id END AS pos FROM v),
f AS (SELECT symbol, ts, event_id, last_value(e IGNORE NULLS) OVER w AS equity, last_value(pos IGNORE NULLS) OVER w AS positions FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
h AS (SELECT *, count(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS n FROM f)
SELECT symbol, event_id, equity AS equity_usd, positions, least(n, 40)::DOUBLE AS points, max(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS peak_usd,
  first_value(equity IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS oldest_usd FROM h""")
def stream_account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as partial payloads of accounts: two of three have a summary, each fifth has positions; 40 points are kept."""
    i = F.col("event_id")
    rows = _events(spark, sf_dir)
    summary = F.when(i % 3 > 0, F.struct(F.col("value").alias("equity_usd")))
    body = F.to_json(F.struct(summary.alias("summary"), F.when(i % 5 == 0, F.concat(F.lit("hold "), i.cast("string"))).alias("positions"), i.cast("string").alias("meta")))
    # payloads of one time in the order of their ids, which the microseconds tell
    work = live.account_state(rows.select(F.col("event_type").alias("symbol"), "ts", body.alias("value"), i.alias("no")), 40)
    return run_stateful(stateful(work), new_path(spark, "stream-accounts")).select("symbol", F.col("meta").cast("long").alias("event_id"), "equity_usd", "positions", F.col("points").cast("double").alias("points"), "peak_usd", "oldest_usd")


@add("""WITH t AS (SELECT 'S' || (l_suppkey % 16) AS symbol, l_shipdate AS entry_ts, CASE WHEN l_linenumber < 7 THEN l_shipdate + INTERVAL 1 DAY * l_linenumber END AS exit_ts, l_orderkey FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts DESC NULLS FIRST, entry_ts DESC) AS k FROM t)
SELECT symbol, exit_ts IS NULL AS open, count(*)::BIGINT AS n, max(exit_ts) AS newest, min(exit_ts) AS oldest FROM k WHERE k <= 200 GROUP BY 1, 2""")
def last_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    days = F.make_dt_interval(F.col("l_linenumber"))
    trades = rows.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 16).cast("string")).alias("symbol"), F.col("l_shipdate").alias("entry_ts"), F.when(F.col("l_linenumber") < 7, F.col("l_shipdate") + days).alias("exit_ts"))
    return live.last_trades(trades).groupBy("symbol", "open").agg(F.count("*").alias("n"), F.max("exit_ts").alias("newest"), F.min("exit_ts").alias("oldest"))
