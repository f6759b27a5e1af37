"""Backfills against sets of minutes, and a stream whose gaps are planned, fetched and filled."""

from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from barquill.streaming import backfill as B
from barquill.streaming import live as L
from barquill.streaming.state import run_stateful, state_of, stateful

T0 = dt.datetime(2024, 1, 1)
INTERVAL = "symbol string, lo timestamp_ntz, hi timestamp_ntz"


def at(m):
    return T0 + dt.timedelta(minutes=m)


def minutes(rows):
    return {(s, m) for s, lo, hi in rows for m in range(int((lo - T0).total_seconds() // 60), int((hi - T0).total_seconds() // 60))}


def frame(spark, rows):
    return spark.createDataFrame([(s, at(lo), at(hi)) for s, lo, hi in rows], INTERVAL)


def collected(df):
    return sorted(tuple(r) for r in df.select("symbol", "lo", "hi").collect())


def test_intervals_like_sets_of_minutes(spark):
    rng = random.Random(1)
    draw = lambda n: [(rng.choice("abc"), lo := rng.randrange(300), lo + rng.randrange(25)) for _ in range(n)]
    wanted, taken = draw(40), draw(40)
    w, t = frame(spark, wanted), frame(spark, taken)
    got = collected(B.minus(w, t))
    have, gone = minutes([(s, at(a), at(b)) for s, a, b in wanted]), minutes([(s, at(a), at(b)) for s, a, b in taken])
    assert minutes(got) == have - gone
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got[:-1], got[1:], strict=True))  # none touch
    cut = collected(B.pages(B.minus(w, t), 60, 7))
    assert minutes(cut) == have - gone and sum((hi - lo).total_seconds() for _, lo, hi in cut) == 60 * len(have - gone)
    assert max((hi - lo).total_seconds() for _, lo, hi in cut) <= 7 * 60
    bars = spark.createDataFrame([(s, at(m)) for s, m in sorted(have)] + [("a", None)], "symbol string, ts timestamp_ntz")
    assert collected(B.covered(bars, 60)) == collected(B.merged(w))
    assert B.minus(w.where("false"), t).count() == 0


def test_every_minute_is_asked_once(spark, tmp_path):
    home = str(tmp_path)
    stored = spark.createDataFrame([("a", at(m)) for m in range(100, 120)], "symbol string, ts timestamp_ntz")
    first = collected(B.ask(frame(spark, [("a", 90, 130), ("a", 95, 140), ("b", 0, 5)]), stored, home, 0, 60, 10))
    assert minutes(first) == minutes([("a", at(90), at(100)), ("a", at(120), at(140)), ("b", at(0), at(5))]) and len(first) == 4
    # asked again while it is in flight: only what is new; the same batch again gives the same
    assert collected(B.ask(frame(spark, [("a", 0, 999)]), stored, home, 0, 60, 10)) == first
    second = collected(B.ask(frame(spark, [("a", 85, 140), ("a", 85, 140)]), stored, home, 1, 60, 10))
    assert minutes(second) == minutes([("a", at(85), at(90))])
    failed = ("a", at(120), at(130))
    told = [(*p, p != failed) for p in first] + [(*first[0], False)]
    for _ in range(2):  # told twice
        B.answered(spark.createDataFrame(told, f"{INTERVAL}, ok boolean"), home, 0)
    for batch in (2, 3):
        again = collected(B.ask(frame(spark, [("a", 85, 145)]), stored, home, batch, 60, 10, most_tries=3))
        assert failed in again and minutes(again) == minutes([failed] + ([("a", at(140), at(145))] if batch == 2 else []))
        B.answered(spark.createDataFrame([(*failed, False)], f"{INTERVAL}, ok boolean"), home, batch)
    assert collected(B.ask(frame(spark, [("a", 85, 145)]), stored, home, 4, 60, 10, most_tries=3)) == []
    states = {(r.symbol, r.lo, r.hi): (r.state, r.tries) for r in B.page_states(B.read_log(spark, home)).collect()}
    assert states[failed] == ("failed", 3) and states[first[0]] == ("got", 1)


def test_gaps_of_a_stream_are_fetched_and_filled(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, close double, filled boolean"
    path, home, log, store = (f"{tmp_path}/{x}" for x in ("in", "up", "log", "stored"))
    bars = [(s, at(m), 100.0 + m) for s in "ab" for m in range(120)]
    rng = random.Random(3)
    come = [b for b in bars if b[1] == T0 or rng.random() > 0.25 or b[1] == at(119)]
    source = spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, close double")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
        stream = L.read_bars(spark, path, spark.createDataFrame([], schema).schema, 1)
        return run_stateful(stateful(L.upserted(stream, size=90)), home)

    L.merge_missing(source.join(spark.createDataFrame(come, source.schema), ["symbol", "ts", "close"]), store, ["symbol", "ts"])
    done = run([(*b, False) for b in come])
    asked = []
    for batch in range(3):
        todo = B.ask(B.requested(done), spark.read.parquet(store), log, batch, 60, 5)
        got = [(r, rng.random() > 0.4 or batch == 2) for r in todo.collect()]
        asked += [tuple(r) for r, ok in got if ok]
        B.answered(spark.createDataFrame([(*r, ok) for r, ok in got], f"{INTERVAL}, ok boolean"), log, batch)
        fine = spark.createDataFrame([tuple(r) for r, ok in got if ok], INTERVAL)
        fetched = source.join(fine, (source.symbol == fine.symbol) & (source.ts >= fine.lo) & (source.ts < fine.hi), "left_semi")
        L.merge_missing(fetched, store, ["symbol", "ts"])
        done = run([(*tuple(r), True) for r in fetched.collect()] * 2)  # delivered twice
    assert len(minutes(asked)) == sum(int((hi - lo).total_seconds() // 60) for _, lo, hi in asked) == len(bars) - len(come)
    assert spark.read.parquet(store).count() == len(bars)
    held = state_of(spark, home, "closes").groupBy("symbol").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()
    assert {r.symbol: list(r.x) for r in held} == {s: [b[2] for b in bars if b[0] == s][-90:] for s in "ab"}
