"""Streams whose rows take steps in order of time, with a state for each symbol that Spark keeps in its state store.

A stream that stops, or is killed, goes on where its checkpoint says: state, waiting rows and written files are those of
the last micro-batch that was whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barquill.functions.tables import exists, shared_dir

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows that are Python's own at once; the others of a symbol are columns.
TAKEN = 1 << 13
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class InOrder:
    """A stream of rows (symbol, ts, others) and the step that each symbol's rows take, in order of time, with a state.

    ``step(state, values)`` takes the other values after ts, in microseconds or nothing, and gives the columns of the rows
    to put out, symbol left out. ``state`` is a dictionary that it changes: single values (``kept``, nothing at first) and lists
    (``lists``, empty at first). Schemas are DDL; ``output`` and ``kept`` are of columns, ``lists`` of elements.
    """

    rows: DataFrame
    output: str
    step: Callable[[dict, tuple], list[dict]]
    kept: str = ""
    lists: dict[str, str] = field(default_factory=dict)


def _micros(values: pd.Series) -> list[int | None]:
    whole = values.astype("datetime64[us]")
    return [None if gone else x for x, gone in zip(whole.astype("int64").tolist(), whole.isna().tolist(), strict=True)]


def _plain(values: pd.Series, kind: T.DataType) -> list:
    """Values as Python's own, nulls and NaN as nothing, times as microseconds."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _micros(values)
    return [None if gone else x for x, gone in zip(values.tolist(), values.isna().tolist(), strict=True)]


def frame_of(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    columns = {}
    for f in schema:
        values = [r.get(f.name) for r in rows]
        timed = isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
        columns[f.name] = pd.to_datetime(pd.Series(values, dtype="Int64"), unit="us") if timed else pd.Series(values, dtype=object)
    return pd.DataFrame(columns)


def _timed(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))


def _columns(pdf: pd.DataFrame, fields: list[T.StructField]) -> pa.Table:
    """Rows as columns, nulls and NaN as nulls, times as microseconds."""
    of = lambda f: pa.array(pdf[f.name].astype("datetime64[us]"), pa.timestamp("us")).cast(pa.int64()) if _timed(f) else pa.array(pdf[f.name], to_arrow_type(f.dataType), from_pandas=True)
    return pa.table([of(f) for f in fields], [f.name for f in fields])


def _tuples(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


class Steps(StatefulProcessor):
    """One symbol's rows, sorted, through its step; rows newer than the symbol's newest less ``wait`` stay in state.

    A symbol's rows of a micro-batch are held as columns, which are put in order, and taken from them a few at a time.
    A late row (older than what was taken in before) is the step's business. Single values are one value state. A list is
    a list state that is appended to where it only grew, and otherwise written anew.
    """

    def __init__(self, rows: T.StructType, output: T.StructType, kept: T.StructType, lists: dict[str, str], step: Callable, wait_seconds: int, ttl_seconds: int | None):
        self.rows, self.output, self.kept, self.lists, self.step = rows, output, kept, lists, step
        self.wait, self.ttl = wait_seconds * 1_000_000, ttl_seconds * 1000 if ttl_seconds else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = self.kept.names
        self.single = handle.getValueState("kept", self.kept, self.ttl) if self.names else None
        self.many = {name: handle.getListState(name, f"x {kind}", self.ttl) for name, kind in self.lists.items()}
        fields = [f"`{f.name}` {'long' if f.name == 'ts' else f.dataType.simpleString()}" for f in self.rows if f.name != "symbol"]
        self.waiting = handle.getListState("waiting", ", ".join(fields), self.ttl) if self.wait else None

    def _load(self) -> tuple[dict, dict[str, list]]:
        held = self.single.get() if self.single is not None and self.single.exists() else None
        state: dict[str, Any] = dict(zip(self.names, held if held is not None else [None] * len(self.names), strict=True))
        for name, stored in self.many.items():
            state[name] = [x[0] for x in stored.get()] if stored.exists() else []
        return state, {name: list(state[name]) for name in self.many}

    def _save(self, state: dict, before: dict[str, list]) -> None:
        if self.single is not None:
            self.single.update(tuple(state.get(n) for n in self.names))
        for name, stored in self.many.items():
            now, old = state[name], before[name]
            if now == old:
                continue
            if not now:
                stored.clear()
            elif old and now[: len(old)] == old:
                stored.appendList([(x,) for x in now[len(old) :]])
            else:
                stored.put([(x,) for x in now])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = [f for f in self.rows if f.name != "symbol"]
        held = [tuple(x) for x in self.waiting.get()] if self.waiting is not None and self.waiting.exists() else []
        kinds = [pa.int64() if _timed(f) else to_arrow_type(f.dataType) for f in fields]
        parts = [pa.table([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [f.name for f in fields])] if held else []
        parts += [_columns(pdf, fields) for pdf in rows]
        if not parts:
            return
        table = pa.concat_tables(parts)
        del parts, held
        if self.wait:
            ts = table.column(0)
            later = pc.fill_null(pc.greater(ts, (pc.max(ts).as_py() or 0) - self.wait), False)
            wait = _tuples(table.filter(later))
            table = table.filter(pc.invert(later))
            self.waiting.put(wait) if wait else self.waiting.clear()
        table = table.combine_chunks()
        order = pc.sort_indices(table, sort_keys=[(f.name, "ascending") for f in fields], null_placement="at_end")
        state, before = self._load()
        for at in range(0, len(order), TAKEN):
            out = []
            for row in _tuples(table.take(order.slice(at, TAKEN))):
                out += [{"symbol": key[0]} | x for x in self.step(state, row)]
            if out:
                yield frame_of(out, self.output)
        self._save(state, before)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        state = {n: _plain(initialState[n].head(1), self.kept[n].dataType)[0] for n in self.names if n in row}
        for name in self.many:
            state[name] = list(row[name]) if name in row and row[name] is not None else []
        self._save(state, {name: [] for name in self.many})

    def close(self) -> None:
        pass


def stateful(work: InOrder, wait_seconds: int = 0, before: DataFrame | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The stream of rows that the steps put out.

    Rows of a micro-batch are sorted by time and then by their other values, so neither files nor splits change what comes
    out; a symbol's rows of one micro-batch have to fit in a task, which the reader's files or bytes a trigger bound. With
    ``wait_seconds`` a symbol's rows wait in state until one that much newer has come, so rows that late still find their
    place, across micro-batches and restarts; those that wait at the end stay for the next run.
    ``before`` (symbol, values and lists of the state) is where symbols begin that the stream has no state of; it counts in
    a stream's first micro-batch. A state that was not touched for ``ttl_seconds`` is given up.
    """
    rows = T.StructType([work.rows.schema[c] for c in work.rows.columns])
    output = T.StructType([T.StructField("symbol", rows["symbol"].dataType), *T.StructType.fromDDL(work.output)])
    kept = T.StructType.fromDDL(work.kept) if work.kept else T.StructType([])
    steps = Steps(rows, output, kept, work.lists, work.step, wait_seconds, ttl_seconds)
    first = before.groupBy("symbol") if before is not None else None
    return work.rows.groupBy("symbol").transformWithStateInPandas(steps, output, "Append", "ProcessingTime" if ttl_seconds else "None", first)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk; a stream takes the setting with it, so it is put back."""
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, old) if old is not None else spark.conf.unset(_STORE)


def stream_home(spark: SparkSession, name: str) -> str:
    """Where a stream of this name has its checkpoint and its table: the same folder in every application."""
    return f"{shared_dir(spark)}/barquill-streams/{name}"


def run_stateful(stream: DataFrame, home: str) -> DataFrame:
    """Run over what there is that ``home`` has not seen, and give the whole table that all runs wrote.

    Files are those of micro-batches that were whole, each once, whenever a run was stopped.
    """
    spark = stream.sparkSession
    with rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", f"{home}/table").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/table") if exists(spark, f"{home}/table") else spark.createDataFrame([], stream.schema)


def state_of(spark: SparkSession, home: str, name: str) -> DataFrame:
    """What a stream holds now: (symbol and the columns of) one of its states, ``kept``, ``waiting`` or a list, a row for each element."""
    with rocksdb(spark):
        rows = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", True).load(f"{home}/checkpoint")
    value = next(c for c in ("value", "list_element") if c in rows.columns)
    return rows.select("key.symbol", f"{value}.*")


CYCLE = "symbol string, trade string, kind string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, r_net double"


class Cycles(StatefulProcessor):
    """Entries and exits of a symbol's trades, paired by the trade's name; what waits too long is given up by a timer.

    The halves that wait are read once and written once for a symbol's rows of a micro-batch, and one timer stands for the
    first of them that may be given up.
    """

    def __init__(self, output: T.StructType, hold_seconds: int, cost: float):
        self.output, self.hold, self.cost = output, hold_seconds, cost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "trade string, entry boolean, at long, price double")

    def _load(self) -> dict[tuple[str, bool], tuple[int, Any]]:
        return {(trade, entry): (at, price) for trade, entry, at, price in self.waiting.get()} if self.waiting.exists() else {}

    def _save(self, waiting: dict[tuple[str, bool], tuple[int, Any]]) -> None:
        if waiting:
            self.waiting.put([(*key, *half) for key, half in waiting.items()])
            self.handle.registerTimer(self._until(min(at for at, _ in waiting.values())))
        else:
            self.waiting.clear()

    def _until(self, at: int) -> int:
        """The first millisecond at which a half is given up."""
        return (at + self.hold * 1_000_000) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, waiting = [], self._load()
        for pdf in rows:
            for trade, entry, at, price in zip(pdf["trade"], pdf["entry"], _micros(pdf["event_ts"].dt.tz_localize(None)), _plain(pdf["price"], T.DoubleType()), strict=True):
                entry = bool(entry)
                other = waiting.get((trade, not entry))
                if (trade, entry) in waiting:
                    continue  # said twice: the first stays
                if other is not None and abs(other[0] - at) <= self.hold * 1_000_000:
                    del waiting[trade, not entry]
                    way_in, way_out = ((at, price), other) if entry else (other, (at, price))
                    gain = None if way_in[1] is None or way_out[1] is None else way_out[1] / way_in[1] - 1 - self.cost if way_in[1] else way_out[1] * np.inf
                    out.append({"symbol": key[0], "trade": trade, "kind": "closed", "entry_ts": way_in[0], "exit_ts": way_out[0], "r_net": gain})
                else:
                    waiting[trade, entry] = (at, price)
        self._save(waiting)
        if out:
            yield frame_of(out, self.output)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs(), self._load()
        gone = {k: half for k, half in waiting.items() if self._until(half[0]) <= now}
        if gone:
            self._save({k: half for k, half in waiting.items() if k not in gone})
            yield frame_of([{"symbol": key[0], "trade": trade, "kind": "open" if entry else "exit only", "entry_ts" if entry else "exit_ts": at} for (trade, entry), (at, _) in gone.items()], self.output)

    def close(self) -> None:
        pass


def trade_cycles(events: DataFrame, hold_seconds: int, delay: str = "10 minutes", cost: float = 0.002) -> DataFrame:
    """Trades from a stream of their entries and exits (symbol, trade, entry: yes or no, ts, price), in any order.

    Halves at most ``hold_seconds`` apart make a trade that is ``closed``, with its profit (infinite from a price of 0). A half that has waited longer, in
    event time, is given up as ``open`` (no exit) or ``exit only``, and its state is freed; so it does not matter how rows
    are spread over micro-batches. What is said twice counts once while its other half is awaited. Rows later than
    ``delay`` are not taken.
    """
    timed = events.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", delay).select("symbol", "trade", "entry", "event_ts", "price")
    return timed.groupBy("symbol").transformWithStateInPandas(Cycles(T.StructType.fromDDL(CYCLE), hold_seconds, cost), CYCLE, "Append", "EventTime")
