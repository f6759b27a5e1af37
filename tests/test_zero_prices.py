"""Prices of 0, which the events of larger tables have, against the SQL of the queries on the same bars."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from barquill.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import rows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Two ticks an hour: lows of 0 under other closes, closes of 0, rises from 0 and to it.
PRICES = [(9, 10), (0, 11), (12, 11), (10, 9), (9, 0), (0, 0), (5, 8), (7, 9), (9.5, 9), (0, 12), (13, 14), (14, 3), (3, 4), (4, 5), (5, 6), (6, 0), (7, 7), (8, 9)]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zeros"))
    start = dt.datetime(2024, 1, 1)
    ticks = [(start + dt.timedelta(hours=i + (i > 11) * 3, minutes=20 * k), float(p)) for i, pair in enumerate(PRICES) for k, p in enumerate(pair)]
    spark.createDataFrame([(i, ts, 1, "view", p, "") for i, (ts, p) in enumerate(ticks)], SCHEMA).coalesce(1).write.parquet(f"{path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return path, duck


@pytest.mark.parametrize("name", ["label_entry_contract", "label_gap_veto", "label_trade_active", "label_weight_modes", "label_any_window", "time_range_24h"])
def test_zero_is_a_price(name, spark, zeros):
    path, duck = zeros
    ours, theirs = QUERIES[name](spark, path).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert rows(ours) == rows(theirs)
