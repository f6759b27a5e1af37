"""Queries over streams against their SQL on events that the smallest tables do not have."""

from __future__ import annotations

import datetime as dt

import duckdb
import pandas as pd

import __spark_entry__  # noqa: F401  (registers the queries)
from barquill.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import rows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = dt.datetime(2024, 1, 1)


def check(spark, path, events, name):
    spark.createDataFrame([(i, ts, 1, kind, value, "") for i, ts, kind, value in events], SCHEMA).coalesce(1).write.parquet(f"{path}/events.parquet")
    sql = ORACLE_SQL[name].replace(" events", f" '{path}/events.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(path)).toPandas()) == rows(duckdb.connect().execute(sql.replace(".parquet' e ", ".parquet' AS e ")).df())


def test_scores_of_one_time_are_decided_each(spark, tmp_path):
    check(spark, tmp_path, [(0, T0, "view", 10.0), (1, T0, "view", 90.0), (2, T0, "view", 90.0), (3, T0, "click", 90.0)], "stream_decisions")


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    # the gain is 132.0526875, about
    check(spark, tmp_path, [(0, T0, "view", 1.28), (1, T0 + dt.timedelta(minutes=2), "view", 170.31)], "stream_trade_cycles")


def test_a_gain_from_a_price_of_zero_is_infinite(spark, tmp_path):
    check(spark, tmp_path, [(0, T0, "view", 0.0), (1, T0 + dt.timedelta(minutes=2), "view", 17.0)], "stream_trade_cycles")


def test_a_symbol_is_taken_in_order_a_few_rows_at_a_time(monkeypatch):
    """Rows of several frames, nulls last, in as many steps as rows, and never more of them put out than are taken at once."""
    from pyspark.sql import types as T

    from barquill.streaming import state

    monkeypatch.setattr(state, "TAKEN", 4)
    schema = T.StructType.fromDDL("symbol string, ts timestamp_ntz, close double, filled boolean, note string")
    output = T.StructType.fromDDL("symbol string, ts timestamp_ntz, n int")
    taken = []

    def step(held, row):
        taken.append(row)
        return [{"ts": row[0], "n": len(taken)}]

    steps = state.Steps(schema, output, T.StructType([]), {}, step, 0, None)
    steps.names, steps.single, steps.many, steps.waiting = [], None, {}, None
    given = [(("a", T0 + dt.timedelta(minutes=i * 7 % 5) if i % 6 else None, float(i) if i % 4 else None, i % 2 == 0 if i % 5 else None, f"n{i}" if i % 3 else None)) for i in range(20)]
    frames = [pd.DataFrame(given[at : at + 6], columns=schema.names) for at in range(0, 20, 6)]
    sizes = [len(out) for out in steps.handleInputRows(("a",), iter(frames), None)]
    micros = lambda t: None if t is None else int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert taken == sorted(((micros(r[1]), *r[2:]) for r in given), key=lambda r: tuple((x is None, x) for x in r))
    assert sizes == [4] * 5
