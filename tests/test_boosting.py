"""Boosted trees from summed histograms against a plain fit, with early stop, hot groups and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquill.operators import boosting as G
from barquill.operators import scoring as C
from barquill.operators.boosting import BoostConfig

SMALL = BoostConfig(rounds=4, depth=3, bins=8, rate=0.3, least_rows=5, least_top=10, fractions=(0.1,), patience=2)


def made(n=500, seed=1, groups=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, noise = r.random(), r.choice([None, float("nan"), 0.0, 0.5, 1.0, 2.0]), r.random()
        grp = 0 if i % 3 == 0 else r.randrange(groups)
        y = 1.0 if a + (b if b and b == b else 0) * 0.4 + noise * 0.8 + grp * 0.1 > 1.5 else 0.0
        out.append((i, a, b, grp, y, r.choice([0.5, 1.0, 3.0]), "val" if i % 5 == 4 else "train"))
    return out


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, "id long, a double, b double, grp int, label double, w double, part string").repartition(parts)


def plain_fit(data, cuts, c: BoostConfig):
    """The same trees by loops over rows: gradients of all pairs, all splits by all rows."""
    train = [d for d in data if d[6] != "val"]
    number = lambda x, q: 0 if x is None or x != x else 1 + sum(v < x for v in q)
    bins = {d[0]: (number(d[1], cuts[0]), number(d[2], cuts[1])) for d in data}
    rate = sum(d[5] * d[4] for d in train) / sum(d[5] for d in train)
    base = math.log(rate / (1 - rate)) if c.objective == "logistic" else 0.0
    margin = {d[0]: base for d in data}
    for _ in range(c.rounds):
        g, h = {d[0]: 0.0 for d in train}, {d[0]: 0.0 for d in train}
        if c.objective == "logistic":
            for d in train:
                p = 1 / (1 + math.exp(-margin[d[0]]))
                g[d[0]], h[d[0]] = (p - d[4]) * d[5], p * (1 - p) * d[5]
        else:
            cell = {i: math.floor(abs(m) * G.GRID + 0.5) * (1 if m >= 0 else -1) / G.GRID for i, m in margin.items()}
            for grp in {d[3] for d in train}:
                up, down = [d[0] for d in train if d[3] == grp and d[4] == 1], [d[0] for d in train if d[3] == grp and d[4] == 0]
                for i in up:
                    for j in down:
                        p = 1 / (1 + math.exp(cell[i] - cell[j]))
                        for k, s in ((i, -p), (j, p)):
                            g[k] += s / max(len(up), len(down))
                            h[k] += p * (1 - p) / max(len(up), len(down))
        g, h = {k: round(v * G.SCALE) for k, v in g.items()}, {k: round(v * G.SCALE) for k, v in h.items()}

        def grow(ids, every, depth, value):
            worth = lambda some: (sum(g[i] for i in some) / G.SCALE) ** 2 / (sum(h[i] for i in some) / G.SCALE + c.shrink)
            best = (1e-9, None)
            for f in (0, 1) if depth else ():
                for b in range(max(len(q) for q in cuts) + 2):
                    low, high = [i for i in ids if bins[i][f] <= b], [i for i in ids if bins[i][f] > b]
                    if min(len(low), len(high)) >= c.least_rows and round(worth(low) + worth(high) - worth(ids), 9) > best[0]:
                        best = (round(worth(low) + worth(high) - worth(ids), 9), (f, b))
            if best[1] is None:
                for i in every:
                    margin[i] += value
                return
            f, b = best[1]
            for side in (lambda i: bins[i][f] <= b, lambda i: bins[i][f] > b):
                mine = [i for i in ids if side(i)]
                grow(mine, [i for i in every if side(i)], depth - 1, -c.rate * (sum(g[i] for i in mine) / G.SCALE) / (sum(h[i] for i in mine) / G.SCALE + c.shrink))

        grow([d[0] for d in train], [d[0] for d in data], c.depth, 0.0)
    return margin


@pytest.mark.parametrize("objective", ["pairs", "logistic"])
def test_equals_a_plain_fit(spark, objective):
    data = made()
    c = BoostConfig(**{**SMALL.__dict__, "objective": objective, "patience": 9})
    forest = G.fit(frame(spark, data), ["a", "b"], group="grp", weight="w", config=c)
    # trees that a worse precision dropped again are left out of both
    kept = len(forest.trees)
    assert 1 <= kept <= 4 and len(forest.history) == 4 and kept == 1 + int(np.argmax(forest.history))
    wanted = plain_fit(data, forest.cuts, BoostConfig(**{**c.__dict__, "rounds": kept}))
    found = {r.id: r.margin for r in forest.transform(frame(spark, data, 2)).collect()}
    assert found == pytest.approx(wanted, abs=1e-9)


def test_same_for_any_partitions(spark):
    data = made(seed=4)
    one, other = (G.fit(frame(spark, data, n), ["a", "b"], group="grp", config=SMALL) for n in (1, 7))
    assert one == other


def test_early_stop_takes_the_best_round(spark):
    """Held-out labels have nothing to do with the features: precision soon stops to rise."""
    r = random.Random(9)
    data = [(*d[:4], float(r.random() < 0.3), *d[5:]) for d in made(300, seed=2)]
    c = BoostConfig(**{**SMALL.__dict__, "rounds": 12, "patience": 2})
    forest = G.fit(frame(spark, data), ["a", "b"], group="grp", config=c)
    best = 1 + int(np.argmax(forest.history))
    assert len(forest.trees) == best and (len(forest.history) == 12 or len(forest.history) == best + 2)


def test_order_within_groups_counts(spark):
    """Groups differ in level; what tells rows of one group apart is ``a``. Trained on pairs, the first split is on it."""
    r = random.Random(3)
    data = []
    for i in range(600):
        grp = i % 2
        a, b = r.random(), grp + r.random() * 0.01
        data.append((i, a, b, grp, float(a > 0.7 if grp else a > 0.2), 1.0, "train"))
    pairs = G.fit(frame(spark, data), ["a", "b"], group="grp", config=BoostConfig(**{**SMALL.__dict__, "rounds": 1, "depth": 1}))
    classes = G.fit(frame(spark, data), ["b"], config=BoostConfig(**{**SMALL.__dict__, "objective": "logistic", "rounds": 1, "depth": 1}))
    only_level = G.fit(frame(spark, [(*d[:4], float(d[3]), *d[5:]) for d in data]), ["a", "b"], group="grp", config=SMALL)
    assert pairs.trees[0].feature[0] == 0 and classes.trees and not only_level.trees


def test_calibration_moves_to_the_natural_rate(spark):
    """Positives are half of a sample and a tenth of nature: weighed as in nature, the mean calibrated score is nature's."""
    r = random.Random(5)
    df = spark.createDataFrame([(0.2 + 0.6 * r.random() * y + 0.1 * r.random(), float(y)) for y in (0, 1) * 400], "p double, label double")
    plain, moved = C.fit_platt(df, "p", "label"), C.fit_platt(df, "p", "label", natural_rate=0.1)
    assert plain.prior_shift == 0 and moved.prior_shift == pytest.approx(math.log(1 / 9)) and moved.coef == plain.coef
    nature = F.when(F.col("label") == 1, 0.1).otherwise(0.9)
    mean = lambda c, w: df.select(F.sum(C.calibrated(F.col("p"), c) * w) / F.sum(w)).first()[0]
    assert mean(plain, F.lit(1.0)) == pytest.approx(0.5, abs=0.02) and mean(moved, nature) == pytest.approx(0.1, abs=0.03)


def test_odd_rows(spark):
    data = [(1, None, None, None, 1.0, 1.0, None), (2, 1.0, 2.0, 1, None, 1.0, "train")]
    forest = G.fit(frame(spark, data), ["a", "b"], group="grp", config=SMALL)
    assert forest.trees == [] and [r.margin for r in forest.transform(frame(spark, data)).collect()] == [0.0, 0.0]
    assert G.fit(frame(spark, []), ["a"], config=BoostConfig(objective="logistic", rounds=2)).trees == []
    with pytest.raises(ValueError):
        G.fit(frame(spark, data), ["a"])
    clash = frame(spark, made(60)).withColumn("margin", F.lit("x")).withColumn("p", F.lit("y")).withColumn("g", F.lit(1))
    assert dict(G.fit(clash, ["a"], group="grp", config=SMALL).transform(clash).dtypes)["margin"] == "double"
