"""Places of values by ranges, and what steps remember, against plain walks."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest

from barquill.functions.ranks import percent_ranks
from barquill.operators import memory as K


def test_places_are_those_of_sorted_values(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", None, "b"]) if i % 3 else "hot", 7.0 if i % 3 == 0 else rng.choice([None, float(rng.randrange(400))])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, key string, v double")
    frame = pd.DataFrame(data, columns=["id", "key", "v"]).set_index("id")
    for keys, groups, least in ((None, [frame], 1 << 20), (None, [frame], 50), (["key"], [g for _, g in frame.groupby("key", dropna=False)], 50)):
        got = {r.id: (r.up, r.down) for r in percent_ranks(df, {"up": ("v", True), "down": ("v", False)}, keys, least).collect()}
        assert len(got) == 3000
        for g in groups:
            up, down = g.v.rank(pct=True).fillna(0), g.v.rank(pct=True, ascending=False).fillna(0)
            for i in g.index:
                assert got[i] == (pytest.approx(up[i]), pytest.approx(down[i]))
    assert percent_ranks(df.limit(0), {"up": ("v", True)}).count() == 0


def groups_of(seed: int, steps: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(float(s * 180), f"g{i:02}", [round(rng.random(), 2) for _ in range(3)], round(rng.random(), 1)) for s in range(steps) for i in range(rng.randrange(2, 12))]


def walked(groups: list[tuple], limit: int) -> dict:
    held, out = [], {}
    for step in sorted({g[0] for g in groups}):
        part = [g for g in groups if g[0] == step]
        near, seen = [], []
        for _, _, center, _ in part:
            sims = [(math.exp(-3.2 * math.dist(center, c) - 0.3 * (max(1, abs(s - step) / 180) - 1)), q, s) for s, c, q in held]
            top = sorted((x * (0.75 + 0.25 * q) for x, q, _ in sims), reverse=True)[:4]
            near.append(round(sum(top) / len(top), 12) if top else 0.0)
            seen.append(float(len({s for x, _, s in sims if x >= 0.55})))
        near_rank, seen_rank = pd.Series(near).rank(pct=True), pd.Series(seen).rank(pct=True)
        score = [0.72 * g[3] + 0.2 * near_rank[i] + 0.08 * seen_rank[i] for i, g in enumerate(part)]
        order = sorted(range(len(part)), key=lambda i: (-round(score[i], 12), -part[i][3], part[i][1]))
        for i, g in enumerate(part):
            place = order.index(i) + 1
            out[step, g[1]] = (near[i], seen[i], score[i], place if place <= 3 else None)
        held = (held + [(step, part[i][2], score[i]) for i in order[:3]])[-limit:]
    return out


def of(df) -> dict:
    return {(r.step, r.id): (r.causal_continuity, r.causal_coverage_steps, r.causal_score, r.place) for r in df.collect()}


def test_steps_remember_what_steps_before_chose(spark):
    data = groups_of(1, 6)
    df = spark.createDataFrame(data, "step double, id string, center array<double>, base double")
    scored, memory = K.over_steps(df, limit=7, cell_rows=8)
    got, want = of(scored), walked(data, 7)
    assert got.keys() == want.keys() and len(data) == scored.count()
    for k in want:
        assert got[k][:3] == pytest.approx(want[k][:3], abs=1e-9) and got[k][3] == want[k][3]
    assert memory.count() == 7
    # an earlier run's memory goes on where it ended, and steps it holds are refused
    first, held = K.over_steps(df.where("step < 540"), limit=7)
    second, last = K.over_steps(df.where("step >= 540"), held, limit=7)
    assert of(first) | of(second) == got and sorted(last.collect()) == sorted(memory.collect())
    with pytest.raises(ValueError, match="not after"):
        K.over_steps(df.where("step >= 360"), held)


def test_odd_groups(spark):
    data = [(0.0, "a", [0.1, 0.1], None), (0.0, "b", None, 0.9), (None, "c", [0.5, 0.5], 0.5), (1e8, "a", [0.1, 0.1], 0.0), (1e8, "b", None, 0.1)]
    df = spark.createDataFrame(data, "step double, id string, center array<double>, base double")
    scored, memory = K.over_steps(df)
    got = of(scored)
    assert sorted(got) == [(0.0, "a"), (0.0, "b"), (1e8, "a"), (1e8, "b")]
    assert got[0.0, "b"][3] is None and got[0.0, "a"][3] == 1 and got[1e8, "b"][0] == 0.0
    assert [(r.step, r.place, r.id) for r in memory.collect()] == [(0.0, 1, "a"), (1e8, 1, "a")]
    empty, none = K.over_steps(df.limit(0))
    assert empty.count() == 0 and none.count() == 0 and empty.columns == scored.columns
