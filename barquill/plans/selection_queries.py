"""Sampling, scoring, selection, universe and search as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.functions.ranks import percent_ranks as ranks_of
from barquill.functions.tables import materialize
from barquill.operators import boosting as G
from barquill.operators import memory as K
from barquill.operators import sampling as D
from barquill.operators import scoring as C
from barquill.operators import search as P
from barquill.operators import select as S
from barquill.operators import universe as U
from barquill.plans.feature_queries import _rounded
from barquill.plans.fixtures import BARS, hourly, table
from barquill.plans.metric_queries import trades
from barquill.plans.registry import add

# ---- labelled rows: events; positive above 40, weight up to 7


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", "ts", F.col("event_type").alias("symbol"), (F.col("value") > 40).cast("double").alias("label"), F.round(F.least(F.lit(7.0), F.col("value") / 30), 3).alias("weight"), "value",
        F.round((F.pmod(F.col("event_id") * 7919, F.lit(1009)) / 1009 + F.least(F.lit(1.0), F.col("value") / 100)) / 2, 6).alias("score"),
    )


_L = """WITH e AS (SELECT event_id, ts, event_type AS symbol, (value > 40)::INT::DOUBLE AS label, round(least(7, value / 30), 3) AS weight, value,
  round(((event_id * 7919) % 1009 / 1009 + least(1, value / 100)) / 2, 6) AS score, md5('0|' || event_id::VARCHAR) AS h FROM events)"""


@add(_L + """, n AS (SELECT count(*) FILTER (WHERE label >= 0.5) AS p, count(*) FILTER (WHERE label < 0.5) AS n FROM e), q AS (SELECT least(p, floor(3000 / 3.0)) AS qp, least(n, round(least(p, floor(3000 / 3.0)) * 2)) AS qn FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY label >= 0.5 ORDER BY h) AS k FROM e) SELECT event_id, label FROM r, q WHERE k <= CASE WHEN label >= 0.5 THEN qp ELSE qn END""")
def sample_class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.class_ratio(labelled(spark, sf_dir), F.col("event_id"), 3000, 2.0).select("event_id", "label")


@add(_L + """, b AS (SELECT *, floor(weight / 0.1 + 1e-9)::BIGINT AS bin FROM e), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT *, (1 + 1.25::DOUBLE * (bin - min(bin) OVER ()) / greatest(max(bin) OVER () - min(bin) OVER (), 1)) * pow(n, 0.75) AS share FROM c), x AS (SELECT *, 2000.0 * share / sum(share) OVER () AS exact FROM s),
y AS (SELECT *, floor(exact) AS base, 2000 - sum(floor(exact)) OVER () AS left_over FROM x), z AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, bin) AS k FROM y),
q AS (SELECT bin, least(n, base + (k <= left_over)::INT) AS quota FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h) AS k FROM b)
SELECT event_id, r.bin, weight FROM r JOIN q USING (bin) WHERE k <= quota""")
def sample_weight_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_weight_bin(labelled(spark, sf_dir), F.col("event_id"), 2000).select("event_id", "bin", "weight")


@add(_L + """, d AS (SELECT event_id, ln((('0x' || substr(h, 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE) / weight AS g FROM e WHERE weight > 0) SELECT event_id FROM d ORDER BY g DESC, event_id LIMIT 500""")
def sample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.weighted(labelled(spark, sf_dir), F.col("event_id"), 500).select("event_id")


@add("""SELECT l_returnflag AS flag, count(*)::DOUBLE AS n, round(sum(CASE WHEN l_discount > 0.01 THEN (l_tax / l_discount)::FLOAT::DOUBLE END), 3) AS total FROM lineitem WHERE l_discount > 0.01 GROUP BY 1""")
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_discount") > 0.01, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("inf"))).alias("x"))
    return _rounded(D.clean(rows, ["x"]).groupBy("flag").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("total")), 3)


@add(_L + """, m AS (SELECT sum(weight) FILTER (WHERE label >= 0.5) AS p, sum(weight) FILTER (WHERE label < 0.5) AS n FROM e), f AS (SELECT *, greatest(0.25, least(4, sqrt(p * n) / p)) AS up, greatest(0.25, least(4, sqrt(p * n) / n)) AS dn FROM m),
a AS (SELECT avg(power_pos) AS ap, avg(power_neg) AS an FROM (SELECT CASE WHEN label >= 0.5 THEN weight END AS power_pos, CASE WHEN label < 0.5 THEN weight END AS power_neg FROM e) x)
SELECT event_id, round(weight * CASE WHEN label >= 0.5 THEN up ELSE dn END * (p + n) / (p * up + n * dn), 6) AS balanced, round(greatest(0.05, least(20, weight / CASE WHEN label >= 0.5 THEN ap ELSE an END)), 6) AS loss_weight FROM e, f, a""")
def balance_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.loss_weights(D.class_weights(labelled(spark, sf_dir)))
    return rows.select("event_id", F.round("balanced", 6).alias("balanced"), F.round("loss_weight", 6).alias("loss_weight"))


@add(_L + """, b AS (SELECT *, least(7, floor(weight))::INT AS bin FROM e) SELECT g.bin::DOUBLE AS bin, count(*) FILTER (WHERE label >= 0.5)::DOUBLE AS pos, count(*) FILTER (WHERE label < 0.5)::DOUBLE AS neg,
  round(coalesce(sum(weight) FILTER (WHERE label >= 0.5), 0), 6) AS pos_mass, round(coalesce(sum(weight) FILTER (WHERE label < 0.5), 0), 6) AS neg_mass FROM range(8) g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY 1""")
def weight_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.weight_histogram(labelled(spark, sf_dir)))


@add("""WITH t AS (SELECT l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM t)
SELECT CASE WHEN before < 0.8 * total THEN 'train' ELSE 'val' END AS part, sum(n)::DOUBLE AS n, min(ts) AS first, max(ts) AS last FROM c GROUP BY 1""")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.split_by_time(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), "l_orderkey"))
    return _rounded(rows.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")))


@add(_L + " SELECT event_id, (ascii(symbol) % 10) * 1000000 + floor(epoch(ts) / 60 / 4320)::BIGINT AS qid FROM e")
def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("event_id", D.rank_group(F.col("ts"), F.ascii("symbol") % 10).cast("long").alias("qid"))


@add(_L + ", q AS (SELECT list(x) AS c FROM (SELECT DISTINCT unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS x FROM e)), b AS (SELECT event_id, len(list_filter(c, lambda x: x <= value)) AS bin FROM e, q), n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1), w AS (SELECT bin, greatest(0.25, least(4, sqrt(avg(n) OVER () / n))) AS balance FROM n) SELECT event_id, round(balance, 6) AS balance FROM b JOIN w USING (bin)")
def regression_balance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.balance_map(labelled(spark, sf_dir), "value").select("event_id", F.round("balance", 6).alias("balance"))


@add(_L + " SELECT round(sum(weight * label) / sum(weight), 6) AS weighted_rate, round(avg(label), 6) AS natural_rate FROM e")
def positive_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    weighted, natural = D.positive_rate(rows, weight="weight").first()[0], D.positive_rate(rows).first()[0]
    return spark.sql("SELECT 1").select(F.round(F.lit(weighted), 6).alias("weighted_rate"), F.round(F.lit(natural), 6).alias("natural_rate"))


@add(_L + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS k, count(*) OVER () AS n FROM e) " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS fraction, max(k)::BIGINT AS k, round(avg(label), 6) AS precision FROM r WHERE k <= greatest(50, round({q} * n))" for q in (0.001, 0.01, 0.05)).replace("AS precision", 'AS "precision"'))
def precision_at_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.precision_at(labelled(spark, sf_dir), "score", "label", "event_id", [0.001, 0.01, 0.05], 50).withColumn("precision", F.round("precision", 6))


_CAL = {
    "isotonic": C.Calibration("isotonic", xs=(0.1, 0.4, 0.8), ys=(0.05, 0.3, 0.9)),
    "platt": C.Calibration("platt", coef=1.3, intercept=-0.4, prior_shift=0.1, tail_blend=0.3, tail_start=0.6, tail_power=1.5, tail_boost=0.2),
}


@add(_L + """, p AS (SELECT event_id, score AS p, CASE WHEN score <= 0.1 THEN 0.05 WHEN score <= 0.4 THEN 0.05 + (score - 0.1) * (0.25 / 0.3) WHEN score <= 0.8 THEN 0.3 + (score - 0.4) * (0.6 / 0.4) ELSE 0.9 END AS iso,
  1 / (1 + exp(-(1.3 * ln(greatest(1e-6, least(1 - 1e-6, score)) / (1 - greatest(1e-6, least(1 - 1e-6, score)))) - 0.3))) AS o, pow(greatest(0, least(1, (score - 0.6) / 0.4)), 1.5) AS d FROM e)
SELECT event_id, round(iso, 9) AS isotonic, round(greatest(0, least(1, o + 0.3 * d * (p - o) + 0.2 * d * (1 - o))), 9) AS platt FROM p""")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.select("event_id", *(F.round(C.calibrated(F.col("score"), c), 9).alias(k) for k, c in _CAL.items()))


_PERIODS = "(VALUES (1, TIMESTAMP '2024-01-05'), (2, TIMESTAMP '2024-01-12'), (3, TIMESTAMP '2024-01-20 06:00:00')) p(period_id, train_end)"


@add(_L + f", a AS (SELECT e.event_id, max_by(period_id, train_end) AS period_id FROM e LEFT JOIN {_PERIODS} ON train_end < e.ts GROUP BY 1) SELECT event_id, period_id FROM a")
def model_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-05'), (2, TIMESTAMP_NTZ '2024-01-12'), (3, TIMESTAMP_NTZ '2024-01-20 06:00:00') AS p(period_id, train_end)")
    return C.as_of(labelled(spark, sf_dir), periods).select("event_id", "period_id")


@add(f"""WITH {BARS}, h AS (SELECT symbol, ts, close FROM bars)
SELECT e.event_id, h.close AS price FROM events e ASOF LEFT JOIN h ON e.event_type = h.symbol AND e.ts >= h.ts""")
def price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = hourly(spark, sf_dir).select("symbol", "ts", F.col("close").alias("price"))
    return C.last_before(labelled(spark, sf_dir).select("event_id", "symbol", "ts"), held, "symbol", "ts", ["price"]).select("event_id", "price")


@add(_L + ", q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM e) SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM e, q")
def clip_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clip_to_quantiles(labelled(spark, sf_dir), "value").select("event_id", F.round("value", 6).alias("value"))


# ---- models: not comparable bit by bit


@add()
def boosted_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = labelled(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double")).withColumn("day", F.dayofmonth("ts").cast("double"))
    model = C.train_classifier(rows, ["score", "hour", "day"], depth=3, rounds=5)
    return model.transform(rows).select("event_id", "label", vector_to_array("probability")[1].alias("p"))


@add()
def boosted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ranked within their symbol and stretch of time; trees stop by the last fifth in time."""
    rows = labelled(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double")).withColumn("day", F.dayofmonth("ts").cast("double"))
    rows = D.split_by_time(rows.withColumn("qid", D.rank_group(F.col("ts"), F.ascii("symbol") % 10).cast("long")))
    forest = G.fit(rows, ["score", "hour", "day"], group="qid", config=G.BoostConfig(rounds=6, depth=3, bins=32, rate=0.3, patience=3, fractions=(0.01, 0.05)))
    return forest.transform(rows).select("event_id", "label", "part", "margin")


@add()
def boosted_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double"))
    return C.train_regressor(rows, ["score", "hour"], "value", depth=3, rounds=5).transform(rows).select("event_id", F.expm1("prediction").alias("predicted"))


@add()
def fitted_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    platt, isotonic = C.fit_platt(rows, "score", "label"), C.fit_isotonic(rows, "score", "label")
    return rows.select("event_id", C.calibrated(F.col("score"), platt).alias("platt"), C.calibrated(F.col("score"), isotonic).alias("isotonic"))


# ---- run log: parts as tried settings


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    m = lambda a, b: (k * a % b) / F.lit(float(b))
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), ((F.col("p_retailprice") - 905) / 2000).alias("ret_pct"), (size % 37 / 100 + 0.01).alias("max_dd"), (1 + size % 29 / 10).alias("profit_factor"), (20 + k * 73 % 400).cast("double").alias("trades"),
        m(31, 100).alias("month_pos_frac"), (k % 5).cast("double").alias("max_neg_month_streak"), m(17, 100).alias("underwater_frac"), (-m(13, 20) / 5).alias("worst_rolling_90d"), (-m(7, 10) / 10).alias("worst_day"),
        (-m(11, 25) / 4).alias("sum5_worst_days"), (-m(3, 8) / 10).alias("worst_14d"), (-m(5, 9) / 6).alias("worst_30d"), (1 + k % 3 / 2).alias("total_exposure"), (0.05 + k % 5 / 20).alias("max_trade_exposure"),
        m(19, 100).alias("top1_share_pos"), (1 + k % 7).cast("double").alias("avg_trades_per_cluster"), (k % 50).cast("double").alias("clusters"), (-m(23, 12) / 50).alias("worst_trade"),
        (size / 50).alias("a"), m(73, 101).alias("b"), m(97, 89).alias("c"), F.col("p_brand").alias("family"),
    )
    return rows.withColumn("score", F.round(S.explore_score(), 6))


_RUN = """WITH p AS (SELECT p_partkey AS k, p_size AS z, p_retailprice AS rp, p_brand AS family FROM part), f AS (
  SELECT k AS id, (rp - 905) / 2000 AS ret_pct, z % 37 / 100 + 0.01 AS max_dd, 1 + z % 29 / 10 AS profit_factor, (20 + k * 73 % 400)::DOUBLE AS trades, k * 31 % 100 / 100 AS month_pos_frac,
    (k % 5)::DOUBLE AS max_neg_month_streak, k * 17 % 100 / 100 AS underwater_frac, -(k * 13 % 20 / 20) / 5 AS worst_rolling_90d, -(k * 7 % 10 / 10) / 10 AS worst_day, -(k * 11 % 25 / 25) / 4 AS sum5_worst_days,
    -(k * 3 % 8 / 8) / 10 AS worst_14d, -(k * 5 % 9 / 9) / 6 AS worst_30d, 1 + k % 3 / 2 AS total_exposure, 0.05 + k % 5 / 20 AS max_trade_exposure, k * 19 % 100 / 100 AS top1_share_pos,
    (1 + k % 7)::DOUBLE AS avg_trades_per_cluster, (k % 50)::DOUBLE AS clusters, -(k * 23 % 12 / 12) / 50 AS worst_trade, z / 50 AS a, k * 73 % 101 / 101 AS b, k * 97 % 89 / 89 AS c, family FROM p
), r AS (SELECT *, round(CASE WHEN ret_pct > 0 THEN ln(1 + ret_pct * 40) / pow(max_dd + 0.04, 1.15) * greatest(0.15, least(0.95, clusters / (clusters + 20)))
  / ((1 + 12 * greatest(0, -worst_rolling_90d)) * (1 + 18 * greatest(0, -worst_trade))) ELSE 0 END, 6) AS score FROM f)"""
_VIABLE = ", v AS (SELECT * FROM r WHERE score > 0 AND ret_pct > 0 AND max_dd > 0 AND max_dd <= 0.35 AND trades >= 30 AND profit_factor >= 1.15)"


@add(_RUN + """ SELECT id, score AS explore, round(CASE WHEN ret_pct <= 0 OR max_dd > 0.3 THEN 0 ELSE sqrt(greatest(0, ret_pct * 100)) * 9 * exp(-8 * max_dd - 18 * greatest(0, max_dd - 0.12) - 0.55 * max_neg_month_streak - 2.25 * underwater_frac
  - 7.5 * greatest(0, -worst_rolling_90d)) * least(1, trades / 120) * greatest(0.85, least(1.25, profit_factor)) * (0.8 + 0.2 * month_pos_frac) END, 6) AS selection,
  round(CASE WHEN ret_pct <= 0 OR max_dd > 0.15 OR worst_day < -0.08 OR sum5_worst_days < -0.22 OR worst_30d < -0.15 THEN 0 ELSE ln(1 + 8 * greatest(0, ret_pct)) * exp(-(12 * max_dd + 42 * greatest(0, max_dd - 0.05) + 18 * greatest(0, -worst_day - 0.015)
  + 7 * greatest(0, -sum5_worst_days - 0.06) + 10 * greatest(0, -worst_14d - 0.04) + 7.5 * greatest(0, -worst_rolling_90d) + 11 * greatest(0, -worst_30d - 0.06) + 0.7 * greatest(0, max_neg_month_streak - 1) + 2.2 * greatest(0, underwater_frac - 0.3)
  + 0.28 * greatest(0, total_exposure - 1) + 1.25 * greatest(0, max_trade_exposure - 0.1))) * (0.86 + 0.14 * month_pos_frac) * least(1, trades / 120) * greatest(0.9, least(1.2, profit_factor)) END, 6) AS survival FROM r""")
def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("id", F.col("score").alias("explore"), F.round(S.selection_score(), 6).alias("selection"), F.round(S.survival_score(), 6).alias("survival"))


def _rank_sql(c: str, descending: bool = False) -> str:
    return f"(rank() OVER (ORDER BY {c}{' DESC' if descending else ''}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"


@add(_RUN + f" SELECT id, round({_rank_sql('trades')}, 6) AS trade_rank, round({_rank_sql('max_dd', True)}, 6) AS dd_rank FROM r")
def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks_of(runs(spark, sf_dir).select("id", "trades", "max_dd"), {"trade_rank": ("trades", True), "dd_rank": ("max_dd", False)})
    return rows.select("id", F.round("trade_rank", 6).alias("trade_rank"), F.round("dd_rank", 6).alias("dd_rank"))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.elite(S.viable(runs(spark, sf_dir)))


_ELITE = _RUN + _VIABLE + """, t AS (SELECT * FROM v WHERE score >= (SELECT quantile_cont(score, 0.75) FROM v)), n AS (SELECT * FROM t WHERE (SELECT count(*) FROM t) >= 40 UNION ALL SELECT * FROM v WHERE (SELECT count(*) FROM t) < 40),
x AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS xa, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS xb, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS xc FROM n)"""


@add(_ELITE + " SELECT id, round(score, 6) AS score, round(xa, 6) AS xa, round(xb, 6) AS xb, round(xc, 6) AS xc FROM x")
def viable_elite_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scaled(best(spark, sf_dir), ["a", "b", "c"])
    return rows.select("id", F.round("score", 6).alias("score"), *(F.round(F.col("x")[i], 6).alias(f"x{c}") for i, c in enumerate("abc")))


_NEAR = _ELITE + """, d AS (SELECT p.id AS a, q.id AS b, sqrt((p.xa - q.xa) ** 2 + (p.xb - q.xb) ** 2 + (p.xc - q.xc) ** 2) AS d FROM x p JOIN x q ON p.id <> q.id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d)"""


@add(_NEAR + """, s AS (SELECT k.a AS id, avg(x.score) AS m, quantile_cont(x.score, 0.25) AS q, stddev_pop(x.score) AS sd, quantile_cont(x.max_dd, 0.5) AS dd FROM k JOIN x ON x.id = k.b WHERE k.k <= greatest(12, least(36, floor(sqrt((SELECT count(*) FROM x)) * 1.5))) GROUP BY 1)
SELECT id, round(m, 12) AS neighbor_mean_score, round(q, 12) AS neighbor_q25_score, round(sd, 12) AS neighbor_score_std, round(dd, 12) AS neighbor_dd_median FROM s""")
def neighbor_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # twelve places: scores have six, a mean of 16 or 32 of them up to five more, and the engines round halves differently
    rows = S.smoothed(S.scaled(best(spark, sf_dir), ["a", "b", "c"]))
    return _rounded(rows.select(F.col("id").cast("string").alias("id"), "neighbor_mean_score", "neighbor_q25_score", "neighbor_score_std", "neighbor_dd_median"), 12).withColumn("id", F.col("id").cast("long"))


@add(_NEAR + """, e AS (SELECT a, b FROM d WHERE d <= 0.06), reach AS (SELECT id AS a, id AS b FROM x UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1)
SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS cluster_id FROM c""".replace("WITH p AS", "WITH RECURSIVE p AS"))
def parameter_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clustered(S.scaled(best(spark, sf_dir), ["a", "b", "c"]), 0.06).select("id", "cluster_id")


from barquill.plans.registry import ORACLE_SQL  # noqa: E402

ORACLE_SQL["parameter_clusters"] = ORACLE_SQL["parameter_clusters"].replace("WITH p AS", "WITH RECURSIVE p AS")


@add()
def robust_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection end to end: neighbours, clusters at the median radius, causal memory, the best of the best cluster."""
    rows = materialize(S.scaled(best(spark, sf_dir), ["a", "b", "c"]), "runs")
    rows = materialize(S.local_scores(S.smoothed(rows)), "runs")
    rows = S.clustered(rows, S.cluster_radius(rows, floor=0.05))
    memory = spark.sql("SELECT * FROM VALUES (0, array(0.5D, 0.5D, 0.5D), 0.8D), (180, array(0.2D, 0.3D, 0.9D), 0.6D) AS m(step, center, quality)")
    stats = S.causal_score(S.continuity(S.cluster_stats(rows), memory, 360))
    joined = rows.join(stats.select("cluster_id", "cluster_score", "causal_cluster_score", F.col("size").alias("cluster_size")), "cluster_id")
    return S.pick(joined, [F.col("causal_cluster_score").desc(), F.col("prudent_variant_score").desc(), F.col("id")], 1, "cluster_id").drop("x")


@add(_RUN + """ SELECT family AS family_key, count(*)::DOUBLE AS family_size, round(quantile_cont(score, 0.5), 6) AS family_score_median, round(quantile_cont(score, 0.25), 6) AS family_score_q25, round(max(score), 6) AS family_score_max,
  round(quantile_cont(max_dd, 0.5), 6) AS family_dd_median FROM r GROUP BY 1""")
def family_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.family_stats(runs(spark, sf_dir).withColumn("family_key", F.col("family"))))


def _family_rank(name: str) -> str:
    c = name.lstrip("-")
    down = " DESC" if name.startswith("-") else ""
    return f"(rank() OVER (PARTITION BY step ORDER BY {c}{down}) + (count(*) OVER (PARTITION BY step, {c}) - 1) / 2) / count(*) OVER (PARTITION BY step)"


_HALVES = {"local_median": "score", "dd_median": "max_dd", "pf_median": "profit_factor", "trade_median": "trades", "month_median": "month_pos_frac", "streak_median": "max_neg_month_streak", "underwater_median": "underwater_frac",
  "roll90_median": "worst_rolling_90d", "total_exposure_median": "total_exposure", "trade_exposure_median": "max_trade_exposure", "prudent_median": "prudent"}
_FAMILIES = _RUN.replace("WITH p AS", "WITH RECURSIVE p AS") + f""", y AS (SELECT *, (id % 9 * 180)::DOUBLE AS step, score * month_pos_frac AS prudent, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS xa,
  (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS xb, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS xc FROM r),
g AS (SELECT step, family AS id, [quantile_cont(xa, 0.5), quantile_cont(xb, 0.5), quantile_cont(xc, 0.5)] AS center, {", ".join(f"round(quantile_cont({c}, 0.5), 12) AS {n}" for n, c in _HALVES.items())},
  round(quantile_cont(score, 0.25), 12) AS local_q25, count(*) AS size FROM y GROUP BY 1, 2),
b AS (SELECT step, id, center, {" + ".join(f"{_family_rank(n)} * {w / 100}" for n, w in S.FAMILY.items())} AS base FROM g)"""


@add(_FAMILIES + """, s AS (SELECT step, row_number() OVER (ORDER BY step) AS turn, list({'id': id, 'center': center, 'base': base}) AS gs FROM b GROUP BY step),
w AS (SELECT 0::BIGINT AS turn, 0::DOUBLE AS step, []::STRUCT(step DOUBLE, center DOUBLE[], quality DOUBLE)[] AS mem, []::STRUCT(ns DOUBLE, nb DOUBLE, id VARCHAR, center DOUBLE[], near DOUBLE, seen DOUBLE)[] AS done
  UNION ALL SELECT turn, step, list_slice(list_concat(mem, list_transform(list_slice(done, 1, 3), lambda d: {'step': step, 'center': d.center, 'quality': -d.ns})), -24, -1), done FROM (
    SELECT turn, step, mem, list_sort(list_transform(near, lambda x: {'ns': -round(0.74 * x.base + 0.2 * (len(list_filter(near, lambda y: y.near < x.near)) + (len(list_filter(near, lambda y: y.near = x.near)) + 1) / 2) / len(near)
      + 0.06 * (len(list_filter(near, lambda y: y.seen < x.seen)) + (len(list_filter(near, lambda y: y.seen = x.seen)) + 1) / 2) / len(near), 12), 'nb': -x.base, 'id': x.id, 'center': x.center, 'near': x.near, 'seen': x.seen})) AS done FROM (
      SELECT turn, step, mem, list_transform(sims, lambda x: {'id': x.id, 'center': x.center, 'base': x.base, 'near': round(coalesce(list_avg(list_slice(list_reverse_sort(list_transform(x.sims, lambda m: m.s * (0.75 + 0.25 * m.q))), 1, 4)), 0), 12),
        'seen': len(list_distinct(list_transform(list_filter(x.sims, lambda m: m.s >= 0.55), lambda m: m.step)))::DOUBLE}) AS near FROM (
        SELECT s.turn, s.step, w.mem, list_transform(s.gs, lambda g: {'id': g.id, 'center': g.center, 'base': g.base, 'sims': list_transform(w.mem, lambda m: {'s': exp(-3.0 * list_distance(g.center, m.center) - 0.3 * (greatest(1, abs(m.step - s.step) / 180) - 1)), 'q': m.quality, 'step': m.step})}) AS sims
        FROM w JOIN s ON s.turn = w.turn + 1)))),
o AS (SELECT step, unnest(list_transform(range(1, len(done) + 1), lambda i: {'d': done[i], 'i': i})) AS u FROM w)
SELECT step, u.d.id AS family, round(-u.d.nb, 6) AS family_score, round(u.d.near, 6) AS continuity, u.d.seen AS coverage_steps, round(-u.d.ns, 6) AS causal_score, CASE WHEN u.i <= 3 THEN u.i END AS place FROM o""")
def families_over_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of nine steps, each scored by what the steps before it remember, 24 families at most."""
    rows = runs(spark, sf_dir).withColumnsRenamed({"family": "family_key"}).withColumn("step", (F.col("id") % 9 * 180).cast("double"))
    rows = rows.withColumn("local_robust_score", F.col("score")).withColumn("prudent_variant_score", F.col("score") * F.col("month_pos_frac"))
    rows = materialize(S.scaled(rows, ["a", "b", "c"]), "runs")
    groups = S.family_scores(rows, "step").join(S.centres(rows, "step", "family_key"), ["step", "family_key"])
    scored, _ = K.over_steps(groups.select("step", F.col("family_key").alias("id"), "center", F.col("family_score").alias("base")), rate=K.FAMILY_RATE, weights=K.FAMILY_WEIGHTS)
    return scored.select(
        "step", F.col("id").alias("family"), F.round("base", 6).alias("family_score"), F.round("causal_continuity", 6).alias("continuity"), F.col("causal_coverage_steps").alias("coverage_steps"), F.round("causal_score", 6).alias("causal_score"), F.col("place").cast("long").alias("place")
    )


@add(_RUN + " SELECT id, format('neg={:.6f}|blend={:.6f}', a, b) AS family_key FROM r")
def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("id", S.family_key([("neg", "a"), ("blend", "b")]).alias("family_key"))


@add(_RUN + ", k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, max_dd, id) AS k FROM r) SELECT family, id, round(score, 6) AS score FROM k WHERE k <= 3")
def best_of_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.pick(runs(spark, sf_dir), [F.col("score").desc(), F.col("max_dd").asc(), F.col("id")], 3, "family")
    return rows.select("family", "id", F.round("score", 6).alias("score"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k % 7 * 180).alias("step"), F.when(k % 5 == 0, "train").when(k % 5 == 1, "refresh").otherwise("backtest").alias("stage"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"),
        F.concat(F.lit("bt_"), (k % 211).cast("string")).alias("backtest_id"), F.concat(F.lit("m"), (k % 53).cast("string")).alias("model_id"), F.concat(F.lit("l"), (k % 17).cast("string")).alias("label_id"), k.alias("ts"),
    )


_LOG = """WITH g AS (SELECT o_orderkey % 7 * 180 AS step, CASE WHEN o_orderkey % 5 = 0 THEN 'train' WHEN o_orderkey % 5 = 1 THEN 'refresh' ELSE 'backtest' END AS stage, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status,
  'bt_' || (o_orderkey % 211) AS backtest_id, 'm' || (o_orderkey % 53) AS model_id, 'l' || (o_orderkey % 17) AS label_id, o_orderkey AS ts FROM orders)"""


@add(_LOG + """ SELECT step, max(regexp_extract(backtest_id, '(\\d+)$', 1)::BIGINT) AS last_number, count(*) FILTER (WHERE status = 'ok' AND stage = 'train') AS trained, count(*) FILTER (WHERE status = 'ok' AND stage = 'backtest') AS tested,
  count(DISTINCT CASE WHEN status = 'ok' THEN model_id END) AS models, count(DISTINCT CASE WHEN status = 'ok' THEN backtest_id END) AS backtests FROM g GROUP BY 1""")
def step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.progress(log(spark, sf_dir))


@add(_LOG + """, t AS (SELECT model_id, max(ts) AS train_ts FROM g WHERE status = 'ok' AND stage = 'train' GROUP BY 1), l AS (SELECT label_id, max(ts) AS refresh_ts FROM g WHERE status = 'ok' AND stage = 'refresh' GROUP BY 1)
SELECT g.ts, train_ts, refresh_ts FROM g LEFT JOIN t USING (model_id) LEFT JOIN l USING (label_id) WHERE status = 'ok' AND stage = 'backtest'""")
def parameter_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lineage(log(spark, sf_dir)).select("ts", F.col("train.ts").alias("train_ts"), F.col("refresh.ts").alias("refresh_ts"))


@add(_LOG + ", d AS (SELECT DISTINCT step, backtest_id FROM g WHERE status = 'ok') SELECT DISTINCT step, backtest_id FROM g ANTI JOIN d USING (step, backtest_id)")
def unfinished_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return S.unfinished(rows.select("step", "backtest_id").distinct(), rows, ["step", "backtest_id"])


# ---- universe


@add("SELECT c_custkey AS symbol_id, c_acctbal AS cap FROM customer WHERE c_acctbal BETWEEN 1000 AND 8000 AND c_mktsegment <> 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def universe_top_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("symbol"), F.col("c_acctbal").alias("cap"), "c_mktsegment")
    denied = rows.where("c_mktsegment = 'MACHINERY'").select("symbol")
    return U.top_caps(rows.select("symbol", "cap"), 1000, 8000, 100, denied).select(F.col("symbol").cast("long").alias("symbol_id"), "cap")


@add("SELECT 'C' || c_custkey AS symbol, round(abs(c_acctbal) * 100)::BIGINT::DOUBLE AS cap FROM customer")
def universe_cap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_replace(F.round(F.abs("c_acctbal") * 100).cast("long").cast("string"), r"(\d)(?=(\d{3})+$)", "$1.")
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(": "), k).alias("value"))
    return U.market_caps(lines.union(spark.sql("SELECT '# a comment: 1.2' AS value")))


_HIST = """WITH t AS (SELECT 'S' || (l_suppkey % 16)::VARCHAR AS symbol, l_shipdate AS exit_ts, round(l_discount - l_tax, 4) * (l_quantity / 5000) AS w FROM lineitem),
h AS (SELECT symbol, count(*) AS trades, sum(w) AS pnl, sum(CASE WHEN w > 0 THEN w ELSE 0 END) AS gains, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS losses, avg((w > 0)::INT) AS win FROM t WHERE exit_ts >= TIMESTAMP '1996-01-01' AND exit_ts < TIMESTAMP '1998-01-01' GROUP BY 1),
k AS (SELECT *, trades / (trades + 20.0) AS trust FROM h), e AS (SELECT *, trust * least(10, gains / greatest(losses, 1e-9)) + 1 - trust AS pf, trust * win + (1 - trust) * 0.5 AS ew FROM k)"""


@add(_HIST + " SELECT symbol, round(trust, 6) AS trust, round(pf, 6) AS eff_pf, round(ew, 6) AS eff_win, round(ln(pf + 1e-9) + 0.5 * (ew - 0.5) + 0.1 * pnl, 6) AS symbol_score FROM e")
def universe_shrunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.shrunk(U.history(trades(spark, sf_dir), "1996-01-01 00:00:00", "1998-01-01 00:00:00"))
    return _rounded(rows.select("symbol", "trust", "eff_pf", "eff_win", "symbol_score"))


@add("""WITH t AS (SELECT 'S' || (l_suppkey % 16)::VARCHAR AS symbol, year(l_shipdate) AS step, round(sum(round(l_discount - l_tax, 4)), 6) AS score FROM lineitem GROUP BY 1, 2)
SELECT symbol, round(list_reduce(list(score ORDER BY step), lambda a, x: 0.5::DOUBLE * a + 0.5::DOUBLE * x), 6) AS ewm FROM t GROUP BY 1""")
def universe_step_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = trades(spark, sf_dir).groupBy("symbol", F.year("exit_ts").alias("step")).agg(F.round(F.sum("r_net"), 6).alias("score"))
    return _rounded(U.smoothed_over_steps(steps))


@add("""WITH s AS (SELECT 'S' || (l_suppkey % 16)::VARCHAR AS symbol, round(sum(round(l_discount - l_tax, 4)), 6) AS score, count(*) AS trades, (l_suppkey % 16) % 2 = 0 AS was FROM lineitem GROUP BY 1, 4),
m AS (SELECT quantile_cont(score, 0.5) AS mid FROM s), w AS (SELECT *, CASE WHEN was AND score < mid THEN 'drop' WHEN NOT was AND score > mid THEN 'add' ELSE 'keep' END AS wish FROM s, m),
t AS (SELECT *, row_number() OVER (PARTITION BY wish ORDER BY CASE WHEN wish = 'drop' THEN score ELSE -score END, symbol) AS turn FROM w), c AS (SELECT *, wish <> 'keep' AND turn <= 2 AS changed FROM t),
a AS (SELECT *, CASE WHEN changed THEN wish = 'add' ELSE was END AS act FROM c), f AS (SELECT *, sum(act::INT) OVER () AS n, row_number() OVER (PARTITION BY act ORDER BY score DESC, symbol) AS fill FROM a)
SELECT symbol, act OR fill <= greatest(0, 10 - n) AS active, CASE WHEN NOT act AND fill <= greatest(0, 10 - n) THEN 'fill' WHEN changed THEN wish ELSE 'keep' END AS reason FROM f""")
def universe_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = trades(spark, sf_dir).groupBy("symbol").agg(F.round(F.sum("r_net"), 6).alias("score"), F.count("*").alias("trades"))
    mid = scores.agg(F.percentile("score", F.lit(0.5)).alias("m")).first().m
    previous = scores.select("symbol", (F.substring("symbol", 2, 5).cast("int") % 2 == 0).alias("active"))
    return U.hysteresis(scores, previous, enter=mid, leave=mid, least_trades=1, max_changes=2, min_active=10)


@add("SELECT i AS step, (DATE '2022-01-01' + (i * 180)::INTEGER)::DATE::VARCHAR AS step_start, (DATE '2022-01-01' + (i * 180 + 180)::INTEGER)::DATE::VARCHAR AS step_end FROM range(6) t(i)")
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.windows("2022-01-01", "2025-01-01", 180, spark)
    return rows.select(F.col("step").cast("long").alias("step"), F.col("step_start").cast("string").alias("step_start"), F.col("step_end").cast("string").alias("step_end"))


# ---- search


@add("""SELECT i, round(list_sum(list_transform(range(24), lambda k: floor(i / pow(3.0, k)) % 3 / pow(3.0, k + 1))), 9) AS v FROM range(1000) t(i)""")
def van_der_corput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("i"), F.round(P.van_der_corput(F.col("id"), 3), 9).alias("v"))


@add("SELECT i AS ordinal, (i * 73 % 245 // 35)::INTEGER AS i0, (i * 73 % 245 // 7 % 5)::INTEGER AS i1, (i * 73 % 7)::INTEGER AS i2 FROM (SELECT i FROM range(245) t(i)) x".replace("(i * 73 % 7)", "(i * 73 % 245 % 7)"))
def permuted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.permuted_grid(spark, [7, 5, 7], 245, 73)


@add(_RUN + """ SELECT id, round(pow(greatest(1e-6, least(1, ret_pct / 0.6)) * greatest(1e-6, least(1, (profit_factor - 1) / 2)) * greatest(1e-6, least(1, (month_pos_frac - 0.3) / 0.4)), 1 / 3) * exp(-6 * greatest(0, max_dd - 0.1)) * least(1, trades / 60), 6) AS fitness,
  round(pow(greatest(ret_pct + 1, 1e-9), 180 / greatest(trades, 1)) - 1, 6) AS ret180 FROM r""")
def ga_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("win_rate", F.col("month_pos_frac"))
    return rows.select("id", F.round(P.fitness(), 6).alias("fitness"), F.round(P.per_days(F.col("ret_pct"), F.col("trades")), 6).alias("ret180"))
