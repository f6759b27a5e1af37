"""Streams whose rows come from several files, in no order, stopped and started again, against plain loops."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from barquill.streaming import live as L
from barquill.streaming.state import rocksdb, run_stateful, state_of, stateful, trade_cycles

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, close double, p double"
WAIT = 3600


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def rows_of(n):
    rng = random.Random(5)
    return [(f"s{i % 3}", minute(i + (i > n // 2) * 60), 100 + 10 * rng.random(), rng.random()) for i in range(n)]


def trades(rows, tau, span):
    out = []
    for symbol in sorted({r[0] for r in rows}):
        entry = None
        for _, ts, close, p in sorted(r for r in rows if r[0] == symbol):
            if entry is None:
                if p >= tau:
                    entry, ema = (ts, close), close
                continue
            ema += 2 / (span + 1) * (close - ema)
            if close < ema:
                out.append((symbol, entry[0], ts, pytest.approx(close / entry[1] - 1.002)))
                entry = None
    return out


def put(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are taken in the order of their times


def read(spark, path, schema=SCHEMA):
    return L.read_bars(spark, path, spark.createDataFrame([], schema).schema, 1)


@pytest.fixture(scope="module")
def parts():
    """900 bars in five files: a bar may come up to 25 minutes late, in a later file than newer ones."""
    rows = rows_of(900)
    rng = random.Random(6)
    come = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() / 60 + rng.uniform(0, 25))
    return rows, [come[i * 180 : (i + 1) * 180] for i in range(5)]


def released(rows):
    """Those that do not wait for newer ones at the end."""
    newest = {s: max(r[1] for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    return [r for r in rows if r[1] <= newest[r[0]] - dt.timedelta(seconds=WAIT)]


def test_rows_late_across_triggers_and_restarts(spark, parts, tmp_path):
    rows, files = parts
    path, home = f"{tmp_path}/in", f"{tmp_path}/trades"
    stream = None
    for i, some in enumerate(files):
        put(spark, some, path)
        if i in (0, 2, 4):  # stopped and started again, once over several triggers
            stream = stateful(L.online_trades(read(spark, path), 0.7, 5), WAIT)
            got = sorted(tuple(r) for r in run_stateful(stream, home).collect())
            seen = [r for part in files[: i + 1] for r in part]
            assert got == trades(released(seen), 0.7, 5)
    assert len(got) > 20
    whole = sorted(tuple(r) for r in run_stateful(stateful(L.online_trades(read(spark, path), 0.7, 5), WAIT), f"{tmp_path}/again").collect())
    assert whole == got
    waiting = state_of(spark, home, "waiting")
    assert waiting.count() == len(rows) - len(released(rows))


def test_a_killed_stream_goes_on(spark, parts, tmp_path):
    rows, files = parts
    path, home = f"{tmp_path}/in", f"{tmp_path}/up"
    for some in files:
        put(spark, some, path)
    stream = stateful(L.upserted(read(spark, path), size=50, step_seconds=180), WAIT)
    with rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", f"{home}/table").option("checkpointLocation", f"{home}/checkpoint").start()
    until = time.time() + 60
    while not (query.lastProgress and query.lastProgress["batchId"] >= 1) and time.time() < until:
        time.sleep(0.02)
    query.stop()  # in the middle of whatever it does
    done = [tuple(r) for r in run_stateful(stateful(L.upserted(read(spark, path), size=50, step_seconds=180), WAIT), home).collect()]
    plain = [tuple(r) for r in run_stateful(stateful(L.upserted(read(spark, path), size=50, step_seconds=180), WAIT), f"{tmp_path}/plain").collect()]
    assert sorted(map(str, done)) == sorted(map(str, plain))
    kinds = [r[1] for r in done]
    assert kinds.count("bar") == len(released(rows)) and kinds.count("gap") == 3 and kinds.count("late") == 0 and max(r[6] for r in done) == 50
    held = {r.symbol: r.n for r in state_of(spark, home, "times").groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert held == {"s0": 50, "s1": 50, "s2": 50}


def test_late_rows_are_told_with_their_delay(spark, tmp_path):
    for minutes in ((5, 6, 6, 7), (1, 8), (3, 9)):
        put(spark, [("a", minute(m), 100.0 + m, 1.0) for m in minutes], f"{tmp_path}/in")
    stream = read(spark, f"{tmp_path}/in")
    done = run_stateful(stateful(L.upserted(stream)), f"{tmp_path}/up").collect()
    assert sorted(r.kind for r in done) == ["bar"] * 5 + ["late", "late", "replace"]
    assert sorted(r.behind_seconds for r in done if r.kind == "late") == [300, 360]
    assert run_stateful(stateful(L.online_trades(stream, 0.5, 3)), f"{tmp_path}/trades").collect() == []


def test_filled_gaps_give_the_window_of_a_stream_without_gaps(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, close double, filled boolean"
    bars = [("a", minute(m), 100.0 + m) for m in range(60)]
    missing = set(range(21, 33)) | {45}
    before = spark.createDataFrame(bars[:10], "symbol string, ts timestamp_ntz, close double")
    live = [(*b, False) for i, b in enumerate(bars) if i >= 10 and i not in missing]
    put(spark, live[:25], f"{tmp_path}/in", schema)
    put(spark, [(*bars[m], True) for m in sorted(missing)[:8]] + live[25:], f"{tmp_path}/in", schema)
    put(spark, [(*bars[m], True) for m in sorted(missing)] + [("a", minute(50), -1.0, True), ("a", minute(5), -1.0, True)], f"{tmp_path}/in", schema)
    work = L.upserted(read(spark, f"{tmp_path}/in", schema), size=40, ready=40)
    done = run_stateful(stateful(work, before=L.window_before(before, 40)), f"{tmp_path}/up").collect()
    gaps = [(r.gap_from, r.gap_to) for r in done if r.kind == "gap"]
    assert gaps == [(minute(21), minute(32)), (minute(45), minute(45))] or sorted(gaps) == [(minute(21), minute(32)), (minute(45), minute(45))]
    kinds = [r.kind for r in done]
    # the window reaches back to minute 20 at the end
    assert kinds.count("fill") == len(missing) and kinds.count("have") == 9 and kinds.count("late") == 1
    closes = state_of(spark, f"{tmp_path}/up", "closes")
    assert [r.x for r in closes.collect()] == [b[2] for b in bars[20:]]
    assert sum(r.ready for r in done) > 0


def test_trades_are_paired_or_given_up(spark, tmp_path):
    schema = "symbol string, trade string, entry boolean, ts timestamp_ntz, price double"
    path = f"{tmp_path}/in"
    put(spark, [("a", "1", True, minute(0), 10.0), ("a", "2", True, minute(1), 10.0), ("b", "3", False, minute(5), 12.0), ("a", "1", True, minute(2), 99.0)], path, schema)
    put(spark, [("a", "1", False, minute(30), 11.0), ("b", "3", True, minute(4), 10.0), ("c", "4", True, minute(130), 1.0)], path, schema)
    put(spark, [("a", "2", False, minute(140), 11.0), ("c", "9", False, minute(131), 1.0), ("c", "4", False, minute(400), 2.0)], path, schema)
    got = run_stateful(trade_cycles(read(spark, path, schema), 3600, "10 minutes", 0.0), f"{tmp_path}/out").collect()
    closed = sorted((r.trade, r.entry_ts, r.exit_ts, r.r_net) for r in got if r.kind == "closed")
    assert closed == [("1", minute(0), minute(30), pytest.approx(0.1)), ("3", minute(4), minute(5), pytest.approx(0.2))]
    given_up = sorted((r.trade, r.kind, r.entry_ts, r.exit_ts) for r in got if r.kind != "closed")
    assert given_up == [("2", "exit only", None, minute(140)), ("2", "open", minute(1), None), ("4", "open", minute(130), None), ("9", "exit only", None, minute(131))]


def test_empty_streams_and_nulls(spark, tmp_path):
    put(spark, [], f"{tmp_path}/none")
    assert run_stateful(stateful(L.upserted(read(spark, f"{tmp_path}/none"))), f"{tmp_path}/a").count() == 0
    put(spark, [(None, minute(1), 1.0, None), ("a", None, 2.0, 0.5), ("a", minute(3), None, None), ("a", minute(3), 4.0, 0.1)], f"{tmp_path}/odd")
    done = run_stateful(stateful(L.upserted(read(spark, f"{tmp_path}/odd"))), f"{tmp_path}/b").collect()
    assert sorted((str(r.symbol), r.kind, str(r.close)) for r in done) == [("None", "bar", "1.0"), ("a", "bar", "4.0"), ("a", "late", "2.0"), ("a", "replace", "None")]
