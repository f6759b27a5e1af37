"""What has to be fetched again: intervals of missing bars, cut into pages, each asked once, with a log of what became of them.

Intervals are rows (symbol, lo, hi), from lo to before hi. The log is a table of events in a folder for each batch, so a
batch that is planned or answered again writes what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquill.functions.tables import exists

LOG = "symbol string, lo timestamp_ntz, hi timestamp_ntz, event string, batch long"


def _seconds(n: Column | int) -> Column:
    return F.make_dt_interval(secs=F.lit(n) if isinstance(n, int) else n)


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals that overlap or touch as one; empty ones and those without an end are left out."""
    order = Window.partitionBy("symbol").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.where("lo < hi").select("symbol", "lo", "hi").withColumn("begins", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("no", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("symbol", "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("no")


def minus(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """What of ``wanted`` no interval of ``taken`` covers, merged: a sweep over the ends of both, by symbol."""

    def ends(rows: DataFrame, w: int, t: int) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("k")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("k")))).alias("x")
        return rows.where("lo < hi").select("symbol", both).select("symbol", "x.at", (F.col("x.k") * w).alias("w"), (F.col("x.k") * t).alias("t"))

    points = ends(wanted, 1, 0).union(ends(taken, 0, 1)).groupBy("symbol", "at").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    order = Window.partitionBy("symbol").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = points.select("symbol", F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), F.sum("w").over(so_far).alias("w"), F.sum("t").over(so_far).alias("t"))
    return merged(rows.where("w > 0 AND t = 0"))


def covered(bars: DataFrame, step_seconds: int) -> DataFrame:
    """The intervals that stored bars cover, each from its time to the next step."""
    order = Window.partitionBy("symbol").orderBy("ts")
    step = _seconds(step_seconds)
    rows = bars.select("symbol", "ts").where("ts IS NOT NULL").withColumn("begins", F.coalesce((F.col("ts") - F.lag("ts").over(order) > step).cast("int"), F.lit(1)))
    rows = rows.withColumn("no", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("symbol", "no").agg(F.min("ts").alias("lo"), (F.max("ts") + step).alias("hi")).drop("no")


def pages(intervals: DataFrame, step_seconds: int, bars: int = 1000) -> DataFrame:
    """Intervals cut into pages of at most ``bars`` bars."""
    page = _seconds(step_seconds * bars)
    starts = F.explode(F.sequence("lo", F.col("hi") - F.expr("INTERVAL 1 MICROSECOND"), page))
    return intervals.withColumn("at", starts).select("symbol", F.col("at").alias("lo"), F.least(F.col("at") + page, F.col("hi")).alias("hi"))


def requested(upserts: DataFrame, step_seconds: int = 60) -> DataFrame:
    """The intervals that the gap rows of ``live.upserted`` ask for."""
    return upserts.where("kind = 'gap'").select("symbol", F.col("gap_from").alias("lo"), (F.col("gap_to") + _seconds(step_seconds)).alias("hi"))


def read_log(spark: SparkSession, home: str) -> DataFrame:
    """(symbol, lo, hi, event, batch): pages that were ``asked``, ``got`` or ``failed``."""
    path = f"{home}/log"
    return spark.read.schema(LOG).parquet(path) if exists(spark, path) else spark.createDataFrame([], LOG)


def page_states(log: DataFrame) -> DataFrame:
    """(symbol, lo, hi, state, tries): the last that is known of each page, and how often it was asked. What was got stays got."""
    place = F.struct("batch", F.when(F.col("event") == "asked", 0).otherwise(1))
    got = F.max((F.col("event") == "got").cast("int")) == 1
    return log.groupBy("symbol", "lo", "hi").agg(F.when(got, "got").otherwise(F.max_by("event", place)).alias("state"), F.count_distinct(F.when(F.col("event") == "asked", F.col("batch"))).alias("tries"))


def plan(wanted: DataFrame, stored: DataFrame, log: DataFrame, step_seconds: int = 60, page_bars: int = 1000, most_tries: int = 5) -> DataFrame:
    """(symbol, lo, hi): the pages to ask for now.

    From ``wanted`` goes what ``stored`` bars cover, what is in flight or was got (a minute that the other side does not
    have is not asked again), and what failed ``most_tries`` times. A page that failed is asked again as it was, unless it is
    no longer wanted whole.
    """
    states = page_states(log)
    closed = states.where((F.col("state") != "failed") | (F.col("tries") >= most_tries)).select("symbol", "lo", "hi")
    open_ = minus(wanted, covered(stored, step_seconds).unionByName(closed))
    again = states.where((F.col("state") == "failed") & (F.col("tries") < most_tries)).select("symbol", "lo", "hi")
    lost = minus(again, open_).select("symbol", F.col("lo").alias("gone_lo"), F.col("hi").alias("gone_hi"))
    cut = (again["lo"] < lost["gone_hi"]) & (lost["gone_lo"] < again["hi"])
    again = again.join(lost, (again["symbol"] == lost["symbol"]) & cut, "left_anti")
    return again.unionByName(pages(minus(open_, again), step_seconds, page_bars))


def _write(rows: DataFrame, home: str, kind: str, batch: int) -> None:
    rows.select("symbol", "lo", "hi", "event").write.mode("overwrite").parquet(f"{home}/log/kind={kind}/batch={batch}")


def ask(wanted: DataFrame, stored: DataFrame, home: str, batch: int, step_seconds: int = 60, page_bars: int = 1000, most_tries: int = 5) -> DataFrame:
    """Plan a batch, write into the log that it was asked, and give its pages; a batch that was asked before gives what it gave."""
    spark = wanted.sparkSession
    if not exists(spark, f"{home}/log/kind=asked/batch={batch}/_SUCCESS"):
        todo = plan(wanted, stored, read_log(spark, home).where(F.col("batch") < batch), step_seconds, page_bars, most_tries)
        _write(todo.withColumn("event", F.lit("asked")), home, "asked", batch)
    return read_log(spark, home).where((F.col("batch") == batch) & (F.col("event") == "asked")).select("symbol", "lo", "hi")


def answered(answers: DataFrame, home: str, batch: int) -> None:
    """Write into the log what became of a batch's pages (symbol, lo, hi, ok); of a page told twice, that it was got."""
    rows = answers.groupBy("symbol", "lo", "hi").agg(F.max("ok").alias("ok"))
    _write(rows.withColumn("event", F.when(F.col("ok"), "got").otherwise("failed")), home, "answered", batch)
