"""Samples, quantiles, live state and small helpers against plain code."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquill.functions import components
from barquill.functions.quantiles import quantiles
from barquill.operators import features as E
from barquill.operators import labels as L
from barquill.operators import sampling as D
from barquill.operators import scoring as C
from barquill.operators import select as S
from barquill.operators import simulate
from barquill.operators.search import neighbours, sampled_choice
from barquill.streaming import live
from barquill.streaming.state import run_stateful, stateful

T0 = dt.datetime(2024, 1, 1)


def test_take_is_the_first_rows_of_each_group(spark):
    data = [(i, i % 3, 10 * (i % 3)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, g int, quota int")
    got = D.by_hash(df, ["g"], "quota", F.col("id")).toPandas()
    import hashlib

    for g in range(3):
        want = sorted((hashlib.md5(f"0|{i}".encode()).hexdigest(), i) for i in range(500) if i % 3 == g)[: 10 * g]
        assert sorted(got[got.g == g].id) == sorted(i for _, i in want)


def test_no_positives_no_rows(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(10)], "id int, label double")
    assert D.class_ratio(df, F.col("id"), 5, 2.0).count() == 0


def test_choices_spread():
    assert len({sampled_choice(range(8), i, base=2) for i in range(1, 9)}) == 8


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 50 + [1.0], [float(i * 37 % 101) for i in range(500)], [None, float("nan"), 2.0, 4.0]])
def test_quantiles_like_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    known = [v for v in values if v is not None and v == v]
    got = quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.98, 1.0])
    assert got is None if not known else got == pytest.approx(np.quantile(known, [0.0, 0.1, 0.25, 0.5, 0.98, 1.0]))


def test_components_like_a_walk(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(0, i) for i in range(300, 380)] + [(i, i + 1) for i in range(400, 430)] + [(7, 7), (None, 3)]
    name = {}
    for a, b in [e for e in edges if None not in e and e[0] != e[1]]:
        one, two = name.setdefault(a, {a}), name.setdefault(b, {b})
        if one is not two:
            one |= two
            for x in two:
                name[x] = one
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(group) for x, group in name.items()}
    pairs = spark.createDataFrame([((2, "x"), (1, "z")), ((1, "z"), (3, "a"))], "a struct<n:int,s:string>, b struct<n:int,s:string>")
    assert {tuple(r.component) for r in components.connected_components(pairs).collect()} == {(1, "z")}
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_split_without_a_second_part(spark):
    rows = lambda times: spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in times], "ts timestamp_ntz")
    parts = lambda times: [r.part for r in D.split_by_time(rows(times)).orderBy("ts").collect()]
    assert parts([0, 0, 0]) == ["train"] * 3 and parts(range(0, 100, 10)) == ["train"] * 8 + ["val"] * 2 and parts([]) == []


def test_least_weight_without_positives_left(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(10)], "id int, label double, weight double")
    assert D.least_weight(df, F.col("id"), positive=50.0).count() == 0
    assert D.least_weight(df, F.col("id"), keep=0.1).where("label = 1").count() == 1
    assert D.rows_for_each(1_000_000, 20) == 50_000 and D.rows_for_each(10, 5) == 20_000 and D.rows_for_each(10**9, 0) == 100_000


def test_exit_mask_needs_a_mode(spark):
    with pytest.raises(ValueError):
        L.exit_mask(spark.range(1), "some")
    assert L.exit_span_bars(7, [60], 60) == 7 and L.exit_span_bars(0, [60], 300) == 12 and L.exit_span_bars(0, [], 60) == 0


def test_account_state_like_a_dictionary(spark, tmp_path):
    payloads = [{"summary": {"equity_usd": 10.0, "cash_usd": 4.0}}, {"positions": [{"symbol": "A"}]}, None, {"summary": {"equity_usd": 12.0}, "positions": []}, {"meta": {"mode": "live"}}]
    rows = [("acc", T0 + dt.timedelta(minutes=i), json.dumps(p) if p is not None else "no json") for i, p in enumerate(payloads)]
    spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, value string").write.parquet(str(tmp_path / "in"))
    stream = live.read_bars(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    got = sorted(run_stateful(stateful(live.account_state(stream, 3)), str(tmp_path / "accounts")).collect(), key=lambda r: r.ts)
    assert [r.equity_usd for r in got] == [10.0, 10.0, 10.0, 12.0, 12.0] and [r.points for r in got] == [1, 2, 3, 3, 3]
    assert [r.cash_usd for r in got] == [4.0] * 3 + [None] * 2 and got[-1].positions == "[]" and got[2].positions == '[{"symbol":"A"}]'
    assert got[-1].oldest_usd == 10.0 and got[-1].peak_usd == 12.0 and got[-1].meta == '{"mode":"live"}'


def test_reloaded_windows(spark):
    stored = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), float(i)) for i in range(10)], "symbol string, ts timestamp_ntz, close double")
    gaps = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=6)), ("a", T0 + dt.timedelta(minutes=1)), ("b", T0)], "symbol string, ts timestamp_ntz")
    got = {(r.symbol, r.ts.minute): [x.close for x in r.window] for r in live.reloaded(gaps, stored, 4).collect()}
    assert got == {("a", 6): [3.0, 4.0, 5.0, 6.0], ("a", 1): [0.0, 1.0], ("b", 0): []}


def test_feature_columns_and_history(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, None, 3, 1.0, "x")], "symbol string, close double, rsi_1 double, empty double, time_since_5 int, label_entry double, note string")
    assert E.feature_columns(df) == ["rsi_1", "time_since_5"] and E.feature_columns(df, ["rsi_1"]) == ["rsi_1"]
    assert E.FeatureConfig().history() == max(E.FeatureConfig().history([b]) for b in E.WINDOWS) == 10080


def test_missing_metrics_are_filled_in(spark):
    runs = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "id int, score double, dd double")
    got = S.enriched(runs, spark.createDataFrame([(1, 9.0, 0.1), (2, 8.0, 0.2)], "id int, score double, dd double"), "id").orderBy("id").collect()
    assert [(r.score, r.dd) for r in got] == [(2.0, 0.1), (8.0, 0.2)]
    top = S.remembered(spark.createDataFrame([(i, [float(i)], float(i % 3)) for i in range(5)], "cluster_id int, center array<double>, causal_cluster_score double"), 180.0, 2)
    assert [(r.step, r.center, r.quality) for r in top.collect()] == [(180.0, [2.0], 2.0), (180.0, [1.0], 1.0)]


def test_small_helpers(spark):
    assert C.threshold_for_adding(0.5) == pytest.approx(0.55) and C.threshold_for_adding(0.95) == 0.99 and C.threshold_for_adding(0.0) == 0.01
    assert list(neighbours([1, 2, 3, 4, 5], 3.2, 1)) == [2, 3, 4] and list(neighbours([1, 2, 3], 0, 2)) == [1, 2, 3]
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000,)], "t long")
    assert {r[0] for r in df.select(live.epoch_millis(F.col("t"))).collect()} == {1_700_000_000_000}
    assert spark.range(1).select(simulate.lot(F.lit(0.30000000000000004), 0.1)).first()[0] == pytest.approx(0.3)
