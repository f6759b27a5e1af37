"""Scores and ranks of settings by many tasks, against windows over the whole table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.ranks import numbered, percent_rank, percent_ranks
from barquill.operators import select as S

NAMES = list(dict.fromkeys(c.lstrip("-") for c in [*S.LOCAL, *S.LOCAL_DD, "neighbor_score_std", "total_exposure", "max_trade_exposure"]))


def settings(spark, n: int = 400) -> DataFrame:
    rng = random.Random(8)
    data = [(i, *(rng.choice([None, *range(7), rng.random()]) if j % 2 else rng.random() for j in range(len(NAMES)))) for i in range(n)]
    data = [tuple(None if v is None else float(v) if k else v for k, v in enumerate(row)) for row in data]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"{c} double" for c in NAMES))


def in_one_task(df: DataFrame) -> bool:
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


def test_many_columns_are_ranked_as_windows_rank_them(spark):
    df = settings(spark)
    wanted = {f"{d}_{c}": (c, d == "up") for c in NAMES for d in ("up", "down")}
    want = {r.id: r for r in df.select("id", *(percent_rank(c, up).alias(n) for n, (c, up) in wanted.items())).collect()}
    for cell_rows in (1 << 14, 30):
        got = percent_ranks(df, wanted, cell_rows=cell_rows)
        assert got.columns == [*df.columns, *wanted]
        assert {r.id: r for r in got.select("id", *wanted).collect()} == want


def test_local_scores_are_not_made_in_one_task(spark):
    df = settings(spark)
    got = S.local_scores(df)
    assert not in_one_task(got)
    down = lambda c: percent_rank(c, False)
    old = lambda w: sum((percent_rank(c.lstrip("-"), not c.startswith("-")) * (x / 100) for c, x in w.items()), F.lit(0.0))
    local = old(S.LOCAL) * (0.85 + 0.15 * down("neighbor_score_std")) * (0.85 + 0.15 * down("neighbor_dd_median"))
    want = df.withColumn("local_robust_score", local).withColumn("local_dd_score", old(S.LOCAL_DD) * (0.82 + 0.18 * down("neighbor_score_std")))
    columns = ["id", "local_robust_score", "local_dd_score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.columns == [*df.columns, "local_robust_score", "local_dd_score", "prudent_variant_score"]


@pytest.mark.parametrize("cell_rows", [1 << 14, 10])
def test_numbers_of_groups_are_dense_ranks(spark, cell_rows):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([None, *range(0, 2000, 13)])) for i in range(600)], "id long, component long")
    got = numbered(df, "component", "n", cell_rows)
    assert not in_one_task(got)
    want = df.withColumn("n", F.dense_rank().over(Window.orderBy("component")) - 1)
    assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())


def test_viable_settings_elite_and_guard_take_no_window_over_all(spark):
    rows = [(i, i / 100, 0.1, 0.2, 50.0 if i % 3 else 10.0, 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, score double, ret_pct double, max_dd double, trades double, profit_factor double")
    got = S.viable(df)
    assert not in_one_task(got)
    strict = [r[0] for r in rows if r[1] > 0 and r[4] >= 30]
    assert sorted(r.id for r in got.collect()) == strict
    none = df.withColumn("trades", F.lit(1.0))
    assert sorted(r.id for r in S.viable(none).collect()) == [r[0] for r in rows if r[1] > 0]
    assert S.viable(df.limit(0)).count() == 0
    cut = df.where(F.col("id").isin(strict)).agg(F.percentile("score", F.lit(0.75))).first()[0]
    best = [i for i in strict if i / 100 >= cut]
    assert sorted(r.id for r in S.elite(got, len(best)).collect()) == best
    assert S.elite(got, len(best) + 1).count() == len(strict)


def test_choices_take_no_window_over_all(spark):
    rng = random.Random(5)
    names = ["score", "max_dd", "local_q25", "dd_median", "local_dd_score", "neighbor_q25_score", "neighbor_mean_score"]
    data = [(i, rng.randrange(1, 4), *(rng.choice([None, 0.25, 0.5, rng.random()]) for _ in names)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, size int, " + ", ".join(f"{c} double" for c in names))
    every = Window.partitionBy()
    half = lambda c: F.percentile(c, F.lit(0.5)).over(every)
    guard = (F.col("size") >= 2).cast("double") * 0.5 + (F.col("local_q25") >= half("local_q25")).cast("double") * 0.3 + (F.col("dd_median") <= half("dd_median")).cast("double") * 0.2
    score = F.col("local_dd_score") * (0.92 + 0.12 * F.col("cluster_guard"))
    local = F.lit(0.0) + F.coalesce("local_dd_score", F.lit(0.0)) * (100 / 100)
    wholes = {
        "cluster_filter": (df.withColumn("cluster_guard", guard).withColumn("robust_score", score), ["cluster_guard", "robust_score", "size", "neighbor_q25_score", "score"]),
        "local_dd": (df.withColumn("dd_rank", percent_rank("max_dd", False)).withColumn("robust_score", local), S.MODES["local_dd"][1]),
    }
    for mode, (want, order) in wholes.items():
        got = S.selected(df, mode, 20)
        assert not in_one_task(got)
        want = S.pick(want, [*(F.col(c).desc_nulls_last() for c in order), F.col("id").asc()], 20)
        assert got.select(want.columns).collect() == want.collect()
