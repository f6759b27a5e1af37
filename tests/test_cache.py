"""What a cache covers, what it computes, and versions that appear whole."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barquill.operators.features import FeatureConfig
from barquill.sources import cache as C
from barquill.sources import versions as V

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def asked(spark, *intervals):
    return spark.createDataFrame([(s, T0 + a * HOUR, T0 + b * HOUR) for s, a, b in intervals], C.COVER)


class Source:
    """Hourly rows, and how many of them were computed."""

    def __init__(self, spark, hours=48):
        self.rows = spark.createDataFrame([(s, T0 + i * HOUR, float(i)) for s in ("a", "b") for i in range(hours)] + [("a", None, 0.0), (None, T0, 0.0)], "symbol string, ts timestamp_ntz, x double")
        self.calls, self.computed = 0, 0

    def __call__(self, missing):
        self.calls += 1
        found = C.inside(self.rows, missing)
        self.computed += found.count()
        # what warms up comes along and has to be left out
        return C.inside(self.rows, C.widened(missing, 7200))


def held(df):
    return sorted((r.symbol, int((r.ts - T0) / HOUR)) for r in df.collect())


def test_miss_hit_and_partial_hit(spark, tmp_path):
    home, source = f"{tmp_path}/c", Source(spark)
    hours = lambda s, a, b: [(s, i) for i in range(a, b)]
    assert held(C.fetch(spark, home, asked(spark, ("a", 10, 20)), source)) == hours("a", 10, 20) and source.computed == 10
    assert held(C.fetch(spark, home, asked(spark, ("a", 12, 15), ("a", 14, 18)), source)) == hours("a", 12, 18) and (source.calls, source.computed) == (1, 10)
    assert held(C.fetch(spark, home, asked(spark, ("a", 5, 25), ("b", 0, 3)), source)) == hours("a", 5, 25) + hours("b", 0, 3) and source.computed == 10 + 10 + 3
    assert sorted(map(tuple, C.cover(spark, home).collect())) == [("a", T0 + 5 * HOUR, T0 + 25 * HOUR), ("b", T0, T0 + 3 * HOUR)]
    at = lambda h: F.lit(T0 + h * HOUR).cast("timestamp_ntz")
    assert [r.symbol for r in C.usable(C.cover(spark, home), at(1), at(3)).collect()] == ["b"]


def test_nothing_there_is_covered_too(spark, tmp_path):
    home, source = f"{tmp_path}/c", Source(spark)
    for _ in range(2):
        assert held(C.fetch(spark, home, asked(spark, ("z", 0, 9), ("a", 60, 70)), source)) == []
    assert source.calls == 1
    assert C.fetch(spark, f"{tmp_path}/none", asked(spark), source).columns == ["symbol", "ts", "x"]


def test_strict_replaces_what_is_stored_in_part(spark, tmp_path):
    home, source = f"{tmp_path}/c", Source(spark)
    C.fetch(spark, home, asked(spark, ("a", 10, 20), ("b", 0, 9)), source, strict=True)
    found = C.fetch(spark, home, asked(spark, ("a", 15, 30), ("b", 1, 5)), source, strict=True)
    assert source.computed == 19 + 15 and held(found) == [("a", i) for i in range(15, 30)] + [("b", i) for i in range(1, 5)]
    assert sorted(r.symbol for r in C.cover(spark, home).collect()) == ["a", "b"]


def test_many_small_parts_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "PARTS", 2)
    home, source = f"{tmp_path}/c", Source(spark)
    for i in range(4):
        found = C.fetch(spark, home, asked(spark, ("a", 0, 3 * i + 3)), source)
    assert held(found) == [("a", i) for i in range(12)] and source.computed == 12
    assert len([n for n in V.pinned(spark, home) if n.startswith("rows-")]) <= 2


def test_keys_tell_settings_apart():
    assert C.key_of(FeatureConfig(candle=3600), 1) == C.key_of(FeatureConfig(candle=3600), 1) != C.key_of(FeatureConfig(candle=60), 1)


def test_readers_see_all_old_or_all_new(spark, tmp_path):
    home = f"{tmp_path}/v"
    table = lambda n: spark.range(n)
    assert V.pinned(spark, home) == {} and V.publish(spark, home, lambda _: {"features": table(5), "labels": table(5)}) == 1
    open_ = V.read(spark, home, "labels")
    before = V.pinned(spark, home)

    def broken(folders):
        assert folders == before
        return {"features": table(7), "labels": table(7).select(F.raise_error(F.lit("no")).alias("id"))}

    with pytest.raises(Exception):
        V.publish(spark, home, broken)
    assert V.pinned(spark, home) == before and V.versions(spark, home) == [1]
    assert V.publish(spark, home, lambda _: {"labels": table(9)}) == 2
    assert open_.count() == 5 and V.read(spark, home, "labels").count() == 9 and V.read(spark, home, "labels", 1).count() == 5
    assert V.pinned(spark, home)["features"] == before["features"]
    V.forget_before(spark, home, 1)
    assert V.versions(spark, home) == [2] and V.read(spark, home, "features").count() == 5


def test_writer_that_comes_second_works_on_what_the_first_left(spark, tmp_path):
    home, tries = f"{tmp_path}/v", []
    V.publish(spark, home, lambda _: {"t": spark.range(1)})

    def slow(folders):
        rows = spark.read.parquet(folders["t"])
        tries.append(rows.count())
        if len(tries) == 1:
            V.publish(spark, home, lambda f: {"t": spark.read.parquet(f["t"]).union(spark.range(10))})
        return {"t": rows.union(spark.range(100))}

    assert V.publish(spark, home, slow) == 3 and tries == [1, 11] and V.read(spark, home, "t").count() == 111

    def always(folders):
        V.publish(spark, home, lambda f: {"u": spark.range(1)})
        return {"t": spark.range(0)}

    with pytest.raises(V.Conflict):
        V.publish(spark, home, always, tries=2)
    assert V.read(spark, home, "t").count() == 111
