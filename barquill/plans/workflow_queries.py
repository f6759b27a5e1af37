"""Whole jobs as queries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.functions.tables import materialize, new_path
from barquill.operators import sampling as D
from barquill.operators import select as S
from barquill.operators import universe as U
from barquill.plans import selection_queries as Q
from barquill.plans import workflows as J
from barquill.plans.feature_queries import _rounded
from barquill.plans.fixtures import BARS, TRADES, table, ticks
from barquill.plans.fixtures import trades as trades_
from barquill.plans.metric_queries import trades
from barquill.plans.registry import add


@add("""WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events GROUP BY 1, 2), e AS (SELECT symbol, min(ts) AS first, max(ts) AS last FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events) x GROUP BY 1)
SELECT symbol, (date_diff('hour', first, last) + 1)::BIGINT AS rows, first, last FROM e""")
def job_build_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.build_bars(ticks(spark, sf_dir), new_path(spark, "job"), 3600, 7200)


@add(f"WITH {BARS} SELECT * FROM bars")
def job_cached_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the middle third of the time are asked for first, then all: the second time only the rest is computed."""
    rows, home = ticks(spark, sf_dir), new_path(spark, "bars-cache")
    ends = rows.groupBy("symbol").agg(F.min("ts").alias("lo"), (F.max("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("hi"))
    third = (F.col("hi") - F.col("lo")) / 3
    J.cached_bars(rows, ends.select("symbol", (F.col("lo") + third).alias("lo"), (F.col("hi") - third).alias("hi")), home, 3600)
    return J.cached_bars(rows, ends, home, 3600)


@add(f"""WITH {TRADES}, t AS (SELECT year(exit_ts) % 2 AS step, symbol, exit_ts::DATE AS day, r_net * weight AS w FROM trades), s AS (SELECT step, symbol, count(*) AS trades, sum(w) AS pnl FROM t GROUP BY 1, 2), d AS (SELECT step, count(DISTINCT day) AS days FROM t GROUP BY 1),
n AS (SELECT step, count(*) AS all_trades FROM t GROUP BY 1) SELECT step::DOUBLE AS step, symbol, trades::DOUBLE AS trades, round(pnl, 6) AS pnl, pnl > 0 AS in_universe, days::DOUBLE AS days, all_trades::DOUBLE AS all_trades FROM s JOIN d USING (step) JOIN n USING (step)""")
def job_step_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of odd and even years as two steps, published in turn, the second twice; what a reader of the newest version has."""
    home, rows = new_path(spark, "reports"), trades_(spark, sf_dir)
    for step in (0, 1, 1):
        part = rows.where(F.year("exit_ts") % 2 == step)
        J.publish_step(spark, home, step, part, part.groupBy(F.lit("all").alias("key"), F.to_date("exit_ts").alias("day")).agg((F.sum("r_net") / 10000).alias("r")))
    report = lambda name: J.step_report(spark, home, name)
    days, all_ = report("equity").groupBy("step").agg(F.count("*").alias("days")), report("trades").groupBy("step").agg(F.count("*").alias("all_trades"))
    chosen = report("universe").select("step", "symbol", F.lit(True).alias("in_universe"))
    out = report("symbols").select("step", "symbol", "trades", "pnl").join(chosen, ["step", "symbol"], "left").join(days, "step").join(all_, "step")
    return _rounded(out.withColumn("in_universe", F.coalesce("in_universe", F.lit(False))))


@add()
def job_walkforward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.labelled(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double"))
    models = J.train_walkforward(rows, ["score", "hour"], ["2024-01-10 00:00:00", "2024-01-20 00:00:00"], "event_id", 4000, 2.0, 3600, depth=3, rounds=5)
    return J.score_walkforward(rows, models, ["event_id", "symbol", "ts", "label"])


@add("SELECT p_partkey AS id, round(p_retailprice / (p_size + 1), 6) AS score, 'ok' AS status FROM part")
def job_explore_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the settings is tried, then the job is called with all of them."""
    path = new_path(spark, "explore")
    configs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    evaluate = lambda t: t.select("id", F.round(F.col("p_retailprice") / (F.col("p_size") + 1), 6).alias("score"))
    J.explore(configs.where("id % 3 = 0"), path, evaluate, ["id"])
    return J.explore(configs, path, evaluate, ["id"])


@add("""WITH r AS (SELECT p_partkey AS id, p_partkey % 6 AS step, p_size * 100 - p_partkey % 97 AS score FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, id) AS k FROM r), b AS (SELECT step + 1 AS step, id FROM k WHERE k = 1),
d AS (SELECT year(o_orderdate) - 1995 AS step, o_orderdate::DATE AS day, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2), e AS (SELECT d.day, round((p / 250000 - 1) / 50 + id % 7 / 10000, 6) AS r, b.step FROM d JOIN b USING (step)),
f AS (SELECT day, min_by(r, step) AS r FROM e GROUP BY 1) SELECT 'all' AS key, day::VARCHAR AS day, round(exp(sum(ln(1 + r)) OVER (ORDER BY day)), 6) AS equity FROM f""")
def job_oos_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("step"), (F.col("p_size") * 100 - F.col("p_partkey") % 97).alias("score"))
    best = S.pick(runs, [F.col("score").desc(), F.col("id").asc()], 1, "step")
    days = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") - 1995).cast("long").alias("step"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("p"))
    earned = days.join(best.select((F.col("step") + 1).alias("step"), "id"), "step").select("id", "step", "day", F.round((F.col("p") / 250000 - 1) / 50 + F.col("id") % 7 / 10000, 6).alias("r"))
    return _rounded(J.walkforward_oos(runs, earned)[1])


@add()
def job_robust_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best setting by every way of selecting."""
    runs = Q.runs(spark, sf_dir).withColumnRenamed("family", "family_key")
    memory = spark.sql("SELECT * FROM VALUES (0, array(0.5D, 0.5D, 0.5D), 0.8D), (180, array(0.2D, 0.3D, 0.9D), 0.6D) AS m(step, center, quality)")
    rows = S.candidates(runs, ["a", "b", "c"], memory, 360, floor=0.05).cache()
    out = None
    for mode in [*S.MODES, "cluster_filter"]:
        best = S.selected(rows, mode).select(F.lit(mode).alias("mode"), "id", "score", "robust_score")
        out = best if out is None else out.union(best)
    return out


@add("""WITH s AS (SELECT 'S' || (l_suppkey % 16)::VARCHAR AS symbol, round(sum(round(l_discount - l_tax, 4) * l_quantity), 4) AS score, round(sum(CASE WHEN l_suppkey % 16 > 9 THEN -1 ELSE 1 END * round(l_discount - l_tax, 4)), 4) AS pnl, count(*) AS trades,
  count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-06-01' AND l_suppkey % 16 % 3 > 0) AS trades_step, l_suppkey % 16 % 2 = 0 AS was FROM lineitem GROUP BY 1, l_suppkey % 16),
w AS (SELECT *, pnl > 0 OR max((pnl > 0)::INT) OVER () = 0 AS wanted FROM s), h AS (SELECT *, row_number() OVER (PARTITION BY wanted AND was ORDER BY score DESC, symbol) AS held FROM w),
t AS (SELECT *, CASE WHEN wanted AND was AND held <= 4 THEN 0 WHEN wanted THEN 1 WHEN trades_step > 0 THEN 2 WHEN trades > 0 THEN 3 ELSE 4 END AS tier FROM h), p AS (SELECT *, row_number() OVER (ORDER BY tier, score DESC, symbol) AS place, sum((tier <= 1)::INT) OVER () AS n FROM t)
SELECT symbol, tier::DOUBLE AS tier FROM p WHERE place <= greatest(least(n, 6), 12)""")
def universe_next_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey") % 16).withColumn("r", F.round(F.col("l_discount") - F.col("l_tax"), 4))
    late = (F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")) & (F.col("k") % 3 > 0)
    ranked = rows.groupBy("k").agg(
        F.round(F.sum(F.col("r") * F.col("l_quantity")), 4).alias("score"), F.round(F.sum(F.when(F.col("k") > 9, -F.col("r")).otherwise(F.col("r"))), 4).alias("pnl"), F.count("*").alias("trades"), F.count_if(late).alias("trades_step")
    )
    ranked = ranked.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("symbol"), "score", "pnl", "trades", "trades_step", (F.col("k") % 2 == 0).alias("was"))
    return _rounded(U.next_active(ranked, most=6, changes=2, least=12))


@add("""WITH e AS (SELECT event_id, ts, (value > 40)::INT AS label, md5('0|' || event_id::VARCHAR) AS h FROM events WHERE ts <= TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) FILTER (WHERE label = 1) OVER () AS p, count(*) FILTER (WHERE label = 0) OVER () AS n FROM e)
SELECT event_id, label::DOUBLE AS label FROM r WHERE k <= CASE WHEN label = 1 THEN least(p, 500) ELSE least(n, least(p, 500) * 3) END""")
def pool_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.pool_slice(Q.labelled(spark, sf_dir), F.col("event_id"), "2024-01-15 00:00:00", 2000, 3.0, 3600)
    return rows.select("event_id", "label")


_CUTOFFS = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 12:00:00"]


@add("WITH c AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{c}'" for c in _CUTOFFS) + """]) AS cutoff), e AS (SELECT cutoff, event_id, (value > 40)::INT AS label, md5('0|' || event_id::VARCHAR) AS h FROM events, c WHERE ts <= cutoff - INTERVAL 1 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY cutoff, label ORDER BY h) AS k, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY cutoff) AS p, count(*) FILTER (WHERE label = 0) OVER (PARTITION BY cutoff) AS n FROM e)
SELECT cutoff::VARCHAR AS cutoff, event_id, label::DOUBLE AS label FROM r WHERE k <= CASE WHEN label = 1 THEN least(p, 500) ELSE least(n, least(p, 500) * 3) END""")
def pool_for_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of three cutoffs, from one pool."""
    pool = materialize(D.bottom_pool(Q.labelled(spark, sf_dir), F.col("event_id"), _CUTOFFS, 2000, 3.0, 3600), "pool")
    out = None
    for cutoff in _CUTOFFS:
        part = D.from_pool(pool, _CUTOFFS, cutoff, F.col("event_id"), 2000, 3.0).select(F.lit(cutoff).alias("cutoff"), "event_id", "label")
        out = part if out is None else out.union(part)
    return out


@add(Q._L + """, q AS (SELECT list(x) AS c FROM (SELECT DISTINCT unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS x FROM e)), b AS (SELECT e.*, len(list_filter(c, lambda x: x <= value)) AS bin FROM e, q), n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1),
w AS (SELECT bin, greatest(0.25, least(4, sqrt(avg(n) OVER () / n))) AS balance FROM n), d AS (SELECT event_id, value, balance, ln((('0x' || substr(h, 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE) / (balance * weight) AS g FROM b JOIN w USING (bin) WHERE weight > 0)
SELECT event_id, value, round(balance, 6) AS balance FROM d ORDER BY g DESC, event_id LIMIT 800""")
def balanced_regression_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.balanced(Q.labelled(spark, sf_dir), F.col("event_id"), "value", 800).select("event_id", "value", F.round("balance", 6).alias("balance"))


@add("SELECT upper(replace(p_brand, '#', '.')) AS raw, replace(upper(replace(p_brand, '#', '.')), '.', '-') AS symbol, count(*)::BIGINT AS n FROM part GROUP BY 1, 2")
def stock_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barquill.sources.files import stock_symbol

    raw = F.upper(F.regexp_replace("p_brand", "#", "."))
    return table(spark, sf_dir, "part").select(raw.alias("raw"), stock_symbol(raw).alias("symbol")).groupBy("raw", "symbol").agg(F.count("*").alias("n"))


@add("""WITH c AS (SELECT c_custkey % 200 AS b, max(c_acctbal) AS cap FROM customer GROUP BY 1), p AS (SELECT DISTINCT s_suppkey % 250 AS b FROM supplier WHERE s_nationkey % 5 > 0)
SELECT 'b' || p.b AS base, cap, cap IS NULL AS skipped FROM p LEFT JOIN c USING (b)""")
def universe_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("B"), (F.col(c) % n).cast("string"))
    pairs = table(spark, sf_dir, "supplier").select(name("s_suppkey", 250).alias("base"), F.when(F.col("s_nationkey") % 5 > 0, "TRADING").otherwise("HALT").alias("status"))
    feed = table(spark, sf_dir, "customer").select(name("c_custkey", 200).alias("symbol"), F.col("c_acctbal").alias("cap"))
    found, skipped = U.discovered(pairs, feed)
    return found.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("cap", F.lit(None).cast("double")).withColumn("skipped", F.lit(True)))


@add("SELECT symbol, count(*)::BIGINT AS n FROM (SELECT 'S' || (l_suppkey % 16)::VARCHAR AS symbol FROM lineitem) x WHERE symbol NOT IN ('S3', 'S5') GROUP BY 1")
def universe_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = spark.sql("SELECT * FROM VALUES ('S3'), ('S5'), ('S5') AS d(symbol)")
    return U.without(trades(spark, sf_dir), denied).groupBy("symbol").agg(F.count("*").alias("n"))
