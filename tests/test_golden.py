"""Small series with values worked out by hand."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquill.functions import rolling as R
from barquill.functions.recursive import averages, span
from barquill.operators.simulate import rolling_correlation
from barquill.operators import bars as B
from barquill.operators import labels as L
from barquill.operators import metrics as M
from barquill.operators import scoring as C
from barquill.operators import select as S
from barquill.operators import universe as U
from barquill.operators.features import PRESETS, FeatureConfig, block_of, build, preset

T0 = dt.datetime(2024, 1, 1)


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    data = [("s", 0, i + 1, T0 + dt.timedelta(minutes=i), *(columns[c][i] for c in columns)) for i in range(n)]
    return spark.createDataFrame(data, f"symbol string, seg int, rn int, ts timestamp_ntz, {', '.join(f'{c} double' for c in columns)}")


def values(df, c):
    return [r[c] for r in df.orderBy("ts").collect()]


def close_to(found, wanted):
    assert [None if x is None else pytest.approx(x) for x in wanted] == found


@pytest.mark.parametrize("minp, wanted", [(1, [1, 1.5, 2.25, 3.125]), (3, [None, None, 2.25, 3.125])])
def test_exponential_average(spark, minp, wanted):
    df = averages(series(spark, close=[1.0, 2.0, 3.0, 4.0]), [("e", lambda p: p["close"], span(3), minp)])
    close_to(values(df, "e"), wanted)


def test_average_passes_over_nulls_and_continues_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = averages(series(spark, close=[1.0, None, 2.0, 3.0, 4.0]), [("e", lambda p: p["close"], span(3), 1)])
        close_to(values(df, "e"), [1, None, 1.5, 2.25, 3.125])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_latest_of_equal_lows_counts(spark):
    df = series(spark, close=[2.0, 1.0, 1.0, 3.0]).withColumn("x", R.since_lowest("close", 3, 1))
    assert values(df, "x") == [0, 0, 0, 1]


def test_true_range_starts_from_its_own_close(spark):
    df = series(spark, high=[10.0, 12.0], low=[8.0, 9.0], close=[9.0, 11.0]).withColumn("x", R.true_range())
    assert values(df, "x") == [2, 3]


def test_slope_looks_back_the_whole_window(spark):
    df = series(spark, lc=[0.0, 1.0, 2.0, 3.0]).withColumn("x", F.when(F.col("rn") >= 2, R.slope("lc", 2)))
    close_to(values(df, "x"), [None, 100, 100, 100])


def test_deviation_is_of_the_population(spark):
    close_to(values(series(spark, close=[1.0, 3.0]).withColumn("x", R.deviation("close", 2)), "x"), [None, 1])


def test_runs(spark):
    df = series(spark, f=[0.0, 0.0, 1.0, 0.0]).withColumn("b", F.col("f") > 0)
    assert values(df.withColumn("x", R.since_true("b")), "x") == [1, 2, 0, 1]
    df = series(spark, f=[1.0, 1.0, 0.0, 1.0]).withColumn("b", F.col("f") > 0)
    assert values(df.withColumn("x", R.run("b")), "x") == [1, 2, 0, 1]


def test_a_null_does_not_spoil_later_windows(spark):
    close_to(values(series(spark, x=[None, 1.0, 1.0, 1.0]).withColumn("m", R.mean("x", 2)), "m"), [None, None, 1, 1])


def test_percent_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 2.0, 2.0, 5.0, None])], "id int, v double")
    got = [r.p for r in df.withColumn("p", S.percent_rank("v")).orderBy("id").collect()]
    assert got == [pytest.approx(x) for x in (0.8, 0.2, 0.5, 0.5, 1.0, 0.0)]
    assert got == [pytest.approx(x) for x in pd.Series([3, 1, 2, 2, 5, None]).rank(pct=True).fillna(0)]


def bars(spark, minutes, close=None):
    close = close or [1.0] * len(minutes)
    data = [("s", T0 + dt.timedelta(minutes=m), c, c, c, c, 1.0) for m, c in zip(minutes, close, strict=True)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_bins_are_named_by_their_left_edge(spark):
    got = B.resample(bars(spark, range(7)), 300).orderBy("ts").collect()
    assert [(r.ts.minute, r.volume) for r in got] == [(0, 5.0), (5, 2.0)]


def test_short_gaps_are_filled_and_long_ones_marked(spark):
    got = B.fill_gaps(bars(spark, [0, 2, 20]), 60, 900).orderBy("ts").collect()
    assert got[1].open == 1.0 and got[1].missing and got[1].volume == 0.0
    assert got[2].gap_after and got[3].open is None and got[3].close == 1.0
    assert len(got) == 21


def test_trades_compound_at_their_exits(spark):
    data = [("s", T0 + dt.timedelta(days=i), i, r, 0.5) for i, r in enumerate([0.1, -0.1])]
    got = M.trade_curve(spark.createDataFrame(data, "symbol string, exit_ts timestamp_ntz, n int, r_net double, weight double"), ["exit_ts"]).orderBy("n").collect()
    assert [r.equity for r in got] == [pytest.approx(1.05), pytest.approx(0.9975)] and got[1].drawdown == pytest.approx(0.05)


def test_union_of_active_trades(spark):
    data = [("s", T0 + dt.timedelta(minutes=i), label, wait) for i, (label, wait) in enumerate([(1.0, 2), (1.0, 0), (0.0, 0), (None, 0), (0.0, 0)])]
    df = L.active(spark.createDataFrame(data, "symbol string, ts timestamp_ntz, entry_label double, exit_wait int"))
    assert values(df, "active") == [True, True, True, False, False]


def test_the_newest_model_that_ended_before(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    periods = spark.createDataFrame([("p1", day(1)), ("p2", day(3))], "period string, train_end timestamp_ntz")
    rows = spark.createDataFrame([(day(n),) for n in (1, 2, 3, 4)], "ts timestamp_ntz")
    assert values(C.as_of(rows, periods), "period") == [None, "p1", "p1", "p2"]


def test_many_ends_a_day_meet_rows_by_equal_days(spark):
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    ends = [37 * i * i % 9000 for i in range(60)]
    periods = spark.createDataFrame([(f"p{m}", at(m)) for m in sorted(set(ends))] + [("none", None)], "period string, train_end timestamp_ntz")
    rows = spark.createDataFrame([(m, at(m)) for m in range(-50, 10_000, 7)] + [(99_999, None)], "m int, ts timestamp_ntz")
    found = C.as_of(rows, periods)
    want = {m: max((e for e in ends if e < m), default=None) for m in range(-50, 10_000, 7)} | {99_999: None}
    assert {r.m: r.period for r in found.collect()} == {m: None if e is None else f"p{e}" for m, e in want.items()}
    assert found.count() == rows.count() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert [r.period for r in C.as_of(rows.limit(3), periods.limit(0)).collect()] == [None] * 3


def test_an_average_equal_to_the_price_is_no_exit(spark):
    got = L.entry_labels(bars(spark, range(3), [100.0, 101.0, 99.0]), L.LabelConfig(horizon=2, exit_span=1)).orderBy("ts").collect()
    assert (got[0].exit_code, got[0].exit_wait) == (-3, 2)


def test_features_do_not_look_ahead(spark):
    import random

    rng, px = random.Random(1), [100.0]
    for _ in range(199):
        px.append(px[-1] * (1 + rng.gauss(0, 0.01)))
    cfg = FeatureConfig(candle=60, windows={k: tuple(tuple(max(1, x // 60) for x in w) if isinstance(w, tuple) else max(1, w // 60) for w in v) for k, v in __import__("barquill.operators.features", fromlist=["WINDOWS"]).WINDOWS.items()})
    whole = build(bars(spark, range(200), px), cfg).orderBy("ts").limit(150).toPandas()
    part = build(bars(spark, range(150), px[:150]), cfg).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(whole, part)
    assert len(whole.columns) > 60 and whole.iloc[-1].notna().mean() > 0.9


def test_rolling_correlation_of_flat_series(spark):
    """A window in which a side does not vary, or has too few pairs, has no correlation."""
    rows = [("k", t, a, b) for t, (a, b) in enumerate([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0), (2.0, None), (2.0, 4.0), (3.0, 6.0)])]
    got = rolling_correlation(spark.createDataFrame(rows, "key string, ts long, a double, b double"), 3, 2).orderBy("ts").collect()
    assert [None if r.correlation is None else round(r.correlation, 9) for r in got] == [None, None, None, None, -1.0, 1.0]


def test_days_without_a_value_carry_the_last_one(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(days=3), 2.0), ("a", T0 + dt.timedelta(days=3, hours=1), 3.0)], "key string, ts timestamp_ntz, equity double")
    assert [r.equity for r in M.daily_curve(df).orderBy("day").collect()] == [1.0, 1.0, 1.0, 3.0]


def test_prices_between_times_and_before_the_first(spark):
    held = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=6), 2.0)], "symbol string, ts timestamp_ntz, price double")
    asked = spark.createDataFrame([(i, "a", T0 + dt.timedelta(hours=h)) for i, h in enumerate((-1, 0, 5, 6, 9))] + [(9, "b", T0)], "n int, symbol string, ts timestamp_ntz")
    assert {r.n: r.price for r in C.last_before(asked, held, "symbol", "ts", ["price"]).collect()} == {0: None, 1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0, 9: None}


def test_symbols_without_a_cap_are_skipped(spark):
    pairs = spark.createDataFrame([("A", "TRADING"), ("B", "TRADING"), ("C", "HALT")], "base string, status string")
    found, skipped = U.discovered(pairs, spark.createDataFrame([("a", 5.0), ("C", 7.0)], "symbol string, cap double").withColumn("symbol", F.upper("symbol")))
    assert [r.base.upper() for r in found.collect()] == ["A"] and [r.base.upper() for r in skipped.collect()] == ["B"]


def test_factors_without_losses_are_infinite(spark):
    df = spark.createDataFrame([("won", 0.1, 1.0), ("lost", -0.1, 1.0), ("even", 0.0, 1.0)], "key string, r_net double, weight double")
    got = {r.key: (r.profit_factor, r.payoff) for r in M.trade_stats(df).collect()}
    assert got == {"won": (float("inf"), float("inf")), "lost": (0.0, 0.0), "even": (0.0, float("inf"))}


def test_calibrations_keep_order_and_mean(spark):
    import random

    rng = random.Random(3)
    data = [(p := rng.random(), float(rng.random() < p * p)) for _ in range(2000)]
    df = spark.createDataFrame(data, "score double, label double")
    for fitted in (C.fit_platt(df, "score", "label"), C.fit_isotonic(df, "score", "label")):
        got = [r.p for r in df.orderBy("score").select(C.calibrated(F.col("score"), fitted).alias("p")).collect()]
        assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
        assert sum(got) / 2000 == pytest.approx(sum(y for _, y in data) / 2000, abs=0.03)


def test_presets_name_features_that_are_made(spark):
    made = block_of()
    assert {k: len(v) for k, v in PRESETS.items()} == {"core80": 87, "core65": 70, "core50": 50} and all(x in made for v in PRESETS.values() for x in v)
    blocks, names = preset("core50")
    rows = build(bars(spark, range(30), [1.0 + 0.1 * (i % 7) for i in range(30)]), FeatureConfig(candle=60, warm_up="progressive"), blocks, names)
    assert sorted(rows.columns[3:]) == sorted(names) and rows.count() == 30
    assert preset("full")[1] is None and "keltner" in preset("core65")[0]
    with pytest.raises(ValueError):
        preset("core1")


def test_a_null_spoils_what_follows_if_asked(spark):
    cfg = FeatureConfig(candle=3600, windows={"keltner_z": (120,)})
    rows = bars(spark, [60 * i for i in range(12)], [1.0 + 0.1 * (i % 5) for i in range(12)])
    z = lambda nulls: values(build(rows, replace(cfg, nulls=nulls), ["keltner"]), "keltner_width_z_120")
    skipped = z("skip")
    assert skipped[0] is None and skipped[-1] is not None and z("poison") == [None] * 12
    cfg = replace(cfg, warm_up="progressive")
    assert z("poison") == z("skip")
