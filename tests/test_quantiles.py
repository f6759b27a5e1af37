"""Quantiles by key and largest values against whole lists, with one key that has nine rows in ten."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from barquill.functions.quantiles import largest_by, quantiles_by
from barquill.operators import metrics as M


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    odd = [None, float("nan"), 0.5, 0.5, -0.25, 1e9]
    out = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), i % 3, rng.choice(odd) if rng.random() < 0.3 else rng.gauss(0, 1), rng.randrange(4)) for i in range(4000)]
    return out + [("one", 0, 2.5, None), ("none", 1, None, None)]


@pytest.mark.parametrize("step_rows", [7, 1 << 20])
def test_like_percentile(spark, rows, step_rows):
    df = spark.createDataFrame(rows, "key string, part int, v double, w int").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {(r.key, r.part): (r.q, r.r) for r in quantiles_by(df, ["key", "part"], {"q": ("v", shares), "r": ("w", [0.5])}, step_rows).collect()}
    sound = F.when(~F.isnan("v"), F.col("v"))
    want = df.groupBy("key", "part").agg(F.percentile(sound, F.array(*map(F.lit, shares))).alias("q"), F.percentile("w", F.array(F.lit(0.5))).alias("r")).collect()
    assert len(got) == len(want)
    for r in want:
        for mine, theirs in zip(got[r.key, r.part], (r.q, r.r), strict=True):
            assert (mine is None) == (theirs is None) and (mine is None or mine == pytest.approx(theirs, rel=1e-12))


def test_no_aggregate_holds_a_key(spark, rows):
    df = spark.createDataFrame(rows, "key string, part int, v double, w int")
    plan = quantiles_by(df, ["key"], {"q": ("v", [0.5])})._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "collect_set" not in plan


def test_largest_and_returns_without_the_best(spark):
    data = [("a", v) for v in (0.1, 0.3, 0.3, -0.2, 0.3, 0.05)] + [("b", -0.5), ("b", None), ("c", None), ("d", 0.2), ("d", 0.2)]
    df = spark.createDataFrame([(k, v, 1.0) for k, v in data], "key string, r_net double, weight double").repartition(3)
    top = {r.key: list(r.top) for r in largest_by(df, "key", "r_net", 2).collect()}
    assert top == {"a": [0.3, 0.3], "b": [-0.5], "d": [0.2, 0.2]}
    got = {r.key: (r.ret, r.ret_wo_best, r.ret_wo_top) for r in M.compounded_without_best(df).collect()}
    for key in "abcd":
        values = sorted((v for k, v in data if k == key and v is not None), reverse=True)
        assert got[key] == pytest.approx(tuple(math.prod(1 + v for v in values[n:]) - 1 for n in (0, 1, 3)))
