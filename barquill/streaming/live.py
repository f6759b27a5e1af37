"""Live bars: messages in, upserts, gaps, decisions and exits, as Structured Streaming."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquill.functions.tables import exists, new_path
from barquill.streaming.state import InOrder

MESSAGE = "data STRUCT<e: STRING, s: STRING, k: STRUCT<t: BIGINT, o: STRING, h: STRING, l: STRING, c: STRING, v: STRING, x: BOOLEAN>>"


def closed_bars(messages: DataFrame, value: str = "value") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of the closed candles in JSON messages; others are passed over."""
    k = F.from_json(F.col(value).cast("string"), MESSAGE)["data"]
    rows = messages.select(k.alias("d")).where("d.k.x")
    number = lambda c: F.col(f"d.k.{c}").try_cast("double")
    ts = F.timestamp_millis(F.col("d.k.t")).cast("timestamp_ntz")
    return rows.select(F.upper("d.s").alias("symbol"), ts.alias("ts"), number("o").alias("open"), number("h").alias("high"), number("l").alias("low"), number("c").alias("close"), number("v").alias("volume"))


def epoch_millis(x: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970 as milliseconds."""
    return F.when(x < 10_000_000_000, x * 1000).when(x < 100_000_000_000_000, x).otherwise(F.floor(x / 1000)).cast("long")


UPSERT = "kind string, ts timestamp_ntz, close double, gap_from timestamp_ntz, gap_to timestamp_ntz, kept int, ready boolean, behind_seconds double"


def upserted(bars: DataFrame, size: int = 500, step_seconds: int = 60, ready: int = 20) -> InOrder:
    """Bars taken into a bounded window for each symbol.

    A bar older than the last is late and ignored (kind ``late``, with how far behind it is), one at the same time replaces
    it (``replace``), a newer one is appended (``bar``); if bars are missing before it, a ``gap`` row says which.
    If ``bars`` has a column ``filled``, rows where it is true are fetched ones: such a bar finds its place among those held
    (``fill``), unless there is one (``have``; the first stays) or the window no longer reaches back to it. So a window whose
    gaps were filled is that of a stream without gaps. State: the last ``size`` closes.
    """
    apart = step_seconds * 1_000_000

    def step(state: dict, row: tuple) -> list[dict]:
        now, close, filled = row
        times, closes, out, behind = state["times"], state["closes"], [], None
        if now is None or (times and now < times[-1] and not filled):
            kind, behind = "late", (times[-1] - now) / 1e6 if now is not None else None
        elif times and filled and now <= times[-1]:
            at = bisect_left(times, now)
            kind = "have" if times[at] == now else "late" if at == 0 and len(times) >= size else "fill"
            if kind == "fill":
                times.insert(at, now)
                closes.insert(at, close)
        elif times and now == times[-1]:
            kind, closes[-1] = "replace", close
        else:
            kind = "bar"
            if times and now - times[-1] > apart:
                out.append({"kind": "gap", "ts": now, "gap_from": times[-1] + apart, "gap_to": now - apart, "kept": len(times), "ready": len(times) >= ready})
            times.append(now)
            closes.append(close)
        del times[:-size], closes[:-size]
        return [*out, {"kind": kind, "ts": now, "close": close, "kept": len(times), "ready": len(times) >= ready, "behind_seconds": behind}]

    filled = F.coalesce(F.col("filled"), F.lit(False)) if "filled" in bars.columns else F.lit(False)
    return InOrder(bars.select("symbol", "ts", F.col("close").cast("double").alias("close"), filled.alias("filled")), UPSERT, step, lists={"times": "long", "closes": "double"})


def window_before(bars: DataFrame, size: int = 500) -> DataFrame:
    """(symbol, times, closes): the last ``size`` stored bars of each symbol, for ``upserted`` to begin with."""
    order = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    last = bars.select("symbol", "ts", F.col("close").cast("double").alias("close")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    held = last.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "close"))).alias("x"))
    return held.select("symbol", F.col("x.at").alias("times"), F.col("x.close").alias("closes"))


POSITIONS = "entry_ts timestamp_ntz, exit_ts timestamp_ntz, r_net double"


def online_trades(scored: DataFrame, tau: float, span: int, cost: float = 0.002) -> InOrder:
    """Trades as they end, from bars (symbol, ts, close, p): entered at p >= tau, left at the first close under an average.

    Bars without a time or a price are passed over, and so are late ones; none is entered at a price of 0. State: when and at what price a symbol was
    entered, the average since, and the last time.
    """
    alpha = 2.0 / (span + 1.0)

    def step(state: dict, row: tuple) -> list[dict]:
        now, close, p = row
        if now is None or close is None or close != close or now < (now if state.get("last") is None else state["last"]):
            return []
        state["last"] = now
        if state.get("entry") is None:
            if p is not None and p >= tau and close:
                state.update(entry=now, price=close, ema=close)
            return []
        state["ema"] += alpha * (close - state["ema"])
        if close >= state["ema"]:
            return []
        done = {"entry_ts": state["entry"], "exit_ts": now, "r_net": close / state["price"] - 1 - cost}
        state.update(entry=None, price=None, ema=None)
        return [done]

    rows = scored.select("symbol", "ts", F.col("close").cast("double").alias("close"), F.col("p").cast("double").alias("p"))
    return InOrder(rows, POSITIONS, step, kept="entry long, price double, ema double, last long")


_FEATURES = ("ret_1", "mean", "spread", "place")


def latest_features(bars: DataFrame, size: int = 500, n: int = 20, ready: int = 20, step_seconds: int = 60) -> InOrder:
    """Features of each symbol's newest bar from the window held for it: ret_1, mean, spread (deviation over mean) and place
    (of the close between the least and the largest) of the last n closes; null until ``ready`` bars are held.

    A bar at the same time as the last replaces it, an older one gives nothing. Where bars are missing before one, the
    window starts anew, and ``reload`` says so: ``reloaded`` has what to fill it with from a stored table.
    """
    apart = step_seconds * 1_000_000

    def step(state: dict, row: tuple) -> list[dict]:
        now, close = row
        times, closes = state["times"], state["closes"]
        if now is None or close is None or (times and now < times[-1]):
            return []
        reload = bool(times) and now - times[-1] > apart
        if reload:
            times.clear()
            closes.clear()
        if times and now == times[-1]:
            closes[-1] = close
        else:
            times.append(now)
            closes.append(close)
            del times[:-size], closes[:-size]
        out = {"ts": now, "close": close, "kept": len(times), "reload": reload}
        if len(times) >= ready:
            last = closes[-n:]
            mean, low, high = sum(last) / len(last), min(last), max(last)
            spread = (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5
            out |= {"ret_1": close / closes[-2] - 1 if len(closes) > 1 and closes[-2] else None, "mean": mean, "spread": spread / mean if mean else None, "place": (close - low) / (high - low) if high > low else 0.5}
        return [out]

    output = "ts timestamp_ntz, close double, kept int, reload boolean, " + ", ".join(f"{c} double" for c in _FEATURES)
    return InOrder(bars.select("symbol", "ts", F.col("close").cast("double").alias("close")), output, step, lists={"times": "long", "closes": "double"})


def reloaded(gaps: DataFrame, stored: DataFrame, size: int = 500) -> DataFrame:
    """(symbol, ts, window): for each gap (symbol, ts) the last ``size`` stored bars up to its time, oldest first.

    Stored bars are numbered by symbol, in one order with the gaps, so that each gap knows the number of the last bar
    before it. Bars and gaps meet by blocks of ``size`` numbers: a window lies in two of them at most.
    """
    order = Window.partitionBy("symbol").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = stored.select("symbol", "ts", "close", F.lit(0).alias("kind")).union(gaps.select("symbol", "ts", F.lit(None).cast("double"), F.lit(1)).distinct())
    both = both.withColumn("no", F.sum(1 - F.col("kind")).over(order) - 1)
    bars = both.where("kind = 0").select("symbol", F.col("ts").alias("at"), "close", "no").withColumn("block", F.expr(f"no div {size}"))
    asked = both.where("kind = 1").select("symbol", "ts", F.col("no").alias("last"))
    asked = asked.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"greatest(last - {size - 1}, 0) div {size}"), F.expr(f"greatest(last, 0) div {size}")))))
    met = asked.join(bars, ["symbol", "block"], "left").withColumn("inside", F.coalesce(F.col("no").between(F.col("last") - (size - 1), F.col("last")), F.lit(False)))
    bar = F.when(F.col("inside"), F.struct(F.col("at").alias("ts"), "close"))
    return met.groupBy("symbol", "ts").agg(F.sort_array(F.collect_list(bar)).alias("window"))


PAYLOAD = "struct<summary:struct<equity_usd:double,cash_usd:double,exposure_usd:double,realized_pnl_usd:double,unrealized_pnl_usd:double,updated_at_utc:string>,positions:string,recent_trades:string,allocation:string,meta:string>"


def account_state(payloads: DataFrame, points: int = 10_080) -> InOrder:
    """The state of each account after each payload (symbol: the account, ts, value: JSON): parts that it has replace the old ones.

    Every payload adds a point to the equity history, with the summary that holds then, once there is one; the last
    ``points`` count (up to a quarter more are held, so that most payloads only append). What is no JSON object changes
    nothing but still adds a point. Puts out the parts, how many points there are, the equity of the oldest and the largest
    of them.
    """
    names = ("equity_usd", "cash_usd", "exposure_usd", "positions", "recent_trades", "allocation", "meta")
    parsed = F.from_json("value", PAYLOAD)
    summary = parsed["summary"]
    rows = payloads.select("symbol", "ts", summary.isNotNull().alias("summed"), *(summary[c].alias(c) for c in names[:3]), *(parsed[c].alias(c) for c in names[3:]))

    def step(state: dict, row: tuple) -> list[dict]:
        now, summed, *parts = row
        for i, (name, value) in enumerate(zip(names, parts, strict=True)):
            if (summed if i < 3 else value is not None):
                state[name] = value
        history = state["history"]
        if state["equity_usd"] is not None:
            history.append(state["equity_usd"])
            if len(history) > points + points // 4:
                del history[:-points]
        some = history[-points:]
        return [{"ts": now} | {name: state[name] for name in names} | {"points": len(some), "oldest_usd": some[0] if some else None, "peak_usd": max(some, default=None)}]

    kept = ", ".join([f"{c} double" for c in names[:3]] + [f"{c} string" for c in names[3:]])
    return InOrder(rows, f"ts timestamp_ntz, {kept}, points int, oldest_usd double, peak_usd double", step, kept, {"history": "double"})


def last_trades(trades: DataFrame, n: int = 200) -> DataFrame:
    """The last n trades of each symbol; those without an exit are open and count as the newest."""
    order = Window.partitionBy("symbol").orderBy(F.col("exit_ts").desc_nulls_first(), F.col("entry_ts").desc())
    return trades.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k").withColumn("open", F.col("exit_ts").isNull())


def decisions(scored: DataFrame, tau: float, delay: str = "10 minutes", apart: tuple[str, ...] = ()) -> DataFrame:
    """One decision for each symbol and time, however often it is scored within the delay.

    Rows of one symbol and time that differ in a column of ``apart`` are decided each.
    """
    once = scored.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["symbol", "event_ts", *apart])
    return once.withColumn("enter", F.col("p") >= tau)


def minute_progress(bars: DataFrame, delay: str = "2 minutes", every: str = "1 minute") -> DataFrame:
    """Bars and symbols by minute; minutes that are late beyond the delay are no longer counted.

    Symbols are counted exactly: a minute's state is the set of them, freed when the minute is over.
    """
    timed = bars.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", delay)
    return timed.groupBy(F.window("event_ts", every)["start"].cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"), F.size(F.collect_set("symbol")).cast("long").alias("symbols"))


def latest(rows: DataFrame) -> DataFrame:
    """The newest score of each symbol; in update mode, those that changed."""
    return rows.groupBy("symbol").agg(F.max_by(F.struct("ts", "p"), "ts").alias("last")).select("symbol", "last.ts", "last.p")


def merge_missing(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows of a batch whose keys a table does not have yet: the first to be written stays."""
    new = batch.dropDuplicates(keys)
    have = batch.sparkSession.read.parquet(path) if exists(batch.sparkSession, path) else None
    (new if have is None else new.join(have.select(*keys), keys, "left_anti")).write.mode("append").parquet(path)


def read_bars(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and give the table that it wrote; each batch is written whole, complete ones replace it."""
    spark = stream.sparkSession
    top = new_path(spark, f"stream-{name}")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/table" if mode == "complete" else f"{top}/table/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/table")


def last_rows(bars: DataFrame, symbol: str, end: str, minutes: int = 1440, tail: int = 500) -> DataFrame:
    """The last bars of a symbol up to a time, at most ``tail`` of them."""
    to = F.lit(end).cast("timestamp_ntz")
    rows = bars.where((F.col("symbol") == symbol) & (F.col("ts") <= to) & (F.col("ts") > to - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(min(minutes, 1440)))))
    return rows.orderBy(F.col("ts").desc()).limit(tail)
