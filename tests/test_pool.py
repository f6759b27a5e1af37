"""A pool that is sampled once gives the samples that all rows give."""

from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from barquill.operators import sampling as D

CUTOFFS = ["2024-01-04 00:00:00", "2024-01-02 12:00:00", "2024-01-09 00:00:00"]


def ticks(spark, n=600, positive=0.3, seed=1):
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(minutes=r.randrange(12 * 1440)) if i % 50 else None, None if i % 37 == 0 else float(r.random() < positive), "x") for i in range(n)]
    return spark.createDataFrame(data, "id long, ts timestamp_ntz, label double, note string")


@pytest.mark.parametrize("most, ratio, horizon", [(40, 3.0, 0), (100_000, 2.0, 7200), (1, 3.0, 0)])
def test_same_as_from_all_rows(spark, most, ratio, horizon):
    rows = ticks(spark)
    pool = D.bottom_pool(rows, F.col("id"), CUTOFFS, most, ratio, horizon).cache()
    for cutoff in CUTOFFS:
        found = D.from_pool(pool, CUTOFFS, cutoff, F.col("id"), most, ratio)
        wanted = D.pool_slice(rows, F.col("id"), cutoff, most, ratio, horizon)
        assert found.columns == wanted.columns and sorted(found.collect()) == sorted(wanted.collect())
    # no more rows of a class and stretch than a sample may take
    largest = pool.groupBy("_stretch", "_side").count().agg(F.max("count")).first()[0]
    assert largest is None or largest <= max(1, most)


def test_without_positives_or_rows(spark):
    for rows in (ticks(spark, positive=0.0), ticks(spark).limit(0)):
        pool = D.bottom_pool(rows, F.col("id"), CUTOFFS, 50, 2.0)
        assert D.from_pool(pool, CUTOFFS, CUTOFFS[0], F.col("id"), 50, 2.0).count() == 0


def test_training_reads_the_rows_once(spark, tmp_path, monkeypatch):
    """The rows' files are deleted as soon as the pool is made: models of all cutoffs come from the pool alone."""
    from barquill.plans import workflows as J

    rows = ticks(spark).where("ts IS NOT NULL AND label IS NOT NULL").withColumns({"symbol": F.col("note"), "f": F.col("id") % 10 + F.col("label")})
    rows.write.parquet(f"{tmp_path}/rows")
    real = J.materialize

    def then_delete(df, name):
        out = real(df, name)
        shutil.rmtree(f"{tmp_path}/rows")
        return out

    monkeypatch.setattr(J, "materialize", then_delete)
    models = J.train_walkforward(spark.read.parquet(f"{tmp_path}/rows"), ["f"], sorted(CUTOFFS), "id", 100, 2.0, depth=2, rounds=2)
    scored = J.score_walkforward(rows, models, ["id"])
    assert [c for c, _ in models] == sorted(CUTOFFS) and scored.select("period_id").distinct().count() == 3
