"""Neighbours and groups against all pairs, on random, clustered, constant and odd tables, and how much is compared."""

from __future__ import annotations

import numpy as np
import pytest

from barquill.functions.nearest import grouped, k_nearest

RNG = np.random.default_rng(4)
TABLES = {
    "random": RNG.random((300, 3)),
    "clustered": np.concatenate([RNG.normal(c, 0.01, (60, 2)) for c in ((0, 0), (1, 0), (0, 1), (0.1, 0.1), (5, 5))]),
    "constant": np.full((120, 2), 0.5),
    "lattice": np.array([[i % 12, i // 12] for i in range(144)] * 2, float),
    "line": np.stack([np.linspace(0, 1, 200), np.zeros(200)], axis=1),
}


def frame(spark, x):
    ids = np.random.default_rng(1).permutation(len(x)) * 3
    rows = [(int(i), [float(v) for v in p]) for i, p in zip(ids, x, strict=True)]
    return rows, spark.createDataFrame([*rows, (None, [0.0]), (10**6, None)], "id long, x array<double>").repartition(3)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_like_all_pairs(spark, name):
    x = TABLES[name]
    rows, df = frame(spark, x)
    ids = np.array([i for i, _ in rows])
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {}
    for r in k_nearest(df, 4, leaf=16).collect():
        got.setdefault(r.a, {})[r["rank"]] = (r.b, r.distance)
    for row, own in enumerate(ids):
        order = [j for j in np.lexsort((ids, apart[row])) if j != row][:4]
        assert [got[own][n][0] for n in (1, 2, 3, 4)] == ids[order].tolist() and [got[own][n][1] for n in (1, 2, 3, 4)] == pytest.approx(apart[row][order].tolist())
    for radius in (0.0, 0.2) if name == "constant" else (0.03, 1.0):
        least = ids.copy()
        while True:
            now = np.array([least[apart[row] <= radius].min() for row in range(len(ids))])
            if (now == least).all():
                break
            least = now
        assert {r.id: r.component for r in grouped(df, radius, leaf=16).collect()} == dict(zip(ids.tolist(), least.tolist(), strict=True))


def test_few_points(spark):
    _, df = frame(spark, np.zeros((0, 2)))
    assert k_nearest(df, 3).count() == 0 and grouped(df, 1.0).count() == 0
    _, df = frame(spark, np.array([[1.0, 2.0], [1.0, 3.0]]))
    assert k_nearest(df, 5).count() == 2 and grouped(df, 2.0).select("component").distinct().count() == 1


@pytest.mark.parametrize("shape", ["random", "clustered"])
def test_compared_grows_less_than_all_pairs(spark, shape):
    for n in (2000, 8000):
        rng = np.random.default_rng(n)
        x = rng.random((n, 2)) if shape == "random" else rng.normal(0, 0.05, (n, 2)) + rng.integers(0, 4, (n, 2))
        _, df = frame(spark, x)
        for work in (lambda df, c: k_nearest(df, 8, 64, c), lambda df, c: grouped(df, 0.55, 64, c)):
            count = spark.sparkContext.accumulator(0)
            out = work(df, count)
            assert out.count() <= 8 * n
            assert count.value < 20 * n**1.5 and count.value < n * n / 3
