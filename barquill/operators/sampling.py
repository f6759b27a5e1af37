"""Data sets: cleaned, sampled to quotas, weighted, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.quantiles import quantiles


def take(df: DataFrame, groups: list[str], quota: str, order: list[Column], bucket: Column) -> DataFrame:
    """The first ``quota`` rows (a column, equal within a group) of each group in ``order``.

    ``bucket`` is a coarse step of the same order. Counts by bucket say which buckets are taken whole; only the one in
    which the quota runs out is ranked, so a group that holds most rows is not sorted in one task.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    keys = [*groups, "_bucket"]
    other = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n", "_before")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(other, same).where(F.col("_before") < F.col(quota))
    whole = rows.where(F.col("_before") + F.col("_n") <= F.col(quota)).select(df.columns)
    cut = rows.where(F.col("_before") + F.col("_n") > F.col(quota))
    cut = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_before") + F.col("_rank") <= F.col(quota))
    return whole.union(cut.select(df.columns))


def drawn(key: Column, seed: str = "0") -> Column:
    """A hash that puts rows in a fixed random order."""
    return F.md5(F.concat(F.lit(seed), F.lit("|"), key.cast("string")))


def by_hash(df: DataFrame, groups: list[str], quota: str, key: Column, seed: str = "0") -> DataFrame:
    h = drawn(key, seed)
    return take(df, groups, quota, [h], F.substring(h, 1, 3))


def clean(df: DataFrame, columns: list[str], how: str = "any") -> DataFrame:
    """Features as floats; what is not finite becomes null, and rows with a null feature go."""
    sound = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).cast("float").alias(c)
    return df.select(*(sound(c) if c in columns else F.col(c) for c in df.columns)).na.drop(how, subset=columns)


def _cycle(rows: DataFrame) -> DataFrame:
    """Adds the state of a position that has just been entered: no additions, no time, no loss, filled at the close."""
    whole = {c: F.lit(0).alias(c) for c in ("cycle_is_add", "cycle_num_adds", "cycle_time_in_trade")}
    return rows.withColumns(whole | {"cycle_dd_pct": F.lit(0.0), "cycle_avg_entry_price": F.col("close"), "cycle_last_fill_price": F.col("close")})


def entry_view(rows: DataFrame, label: str = "entry_label") -> DataFrame:
    """Bars with a label to enter, as ``label_entry``, and the state of a new position."""
    known = F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))
    return _cycle(rows.where(known)).withColumn("label_entry", F.col(label).cast("float"))


def exit_view(rows: DataFrame, target: str = "span_q50", weight: str | None = "span_weight") -> DataFrame:
    """Bars with a finite target above 0 for the exit, as ``label_exit``; ``label_exit_weight`` is 1 at least, and where there is none."""
    x = F.col(target).cast("double")
    out = _cycle(rows.where((x > 0) & (x < float("inf")))).withColumn("label_exit", F.col(target).cast("float"))
    w = F.nanvl(F.col(weight).cast("double"), F.lit(None)) if weight in rows.columns else F.lit(None).cast("double")
    return out.withColumn("label_exit_weight", F.greatest(F.lit(1.0), F.coalesce(w, F.lit(1.0))).cast("float"))


def least_weight(df: DataFrame, key: Column, positive: float = 0.0, negative: float = 0.0, keep: float = 1.0, weight: str = "weight", label: str = "label", seed: str = "0") -> DataFrame:
    """Rows of each class with at least its weight (0: any), and of the positives left a share, rounded, one at least.

    Weights that are not finite count as 0. Where the positives all go, so do the others.
    """
    w = F.coalesce(F.when(~F.isnan(weight) & (F.abs(weight) < float("inf")), F.col(weight)), F.lit(0.0))
    side = F.col(label) >= 0.5
    rows = df.where(F.when(side, w >= positive if positive > 0 else F.lit(True)).otherwise(w >= negative if negative > 0 else F.lit(True)) & F.col(label).isNotNull())
    found = rows.agg(F.count_if(side).alias("n")).first().n
    if not found and positive > 0:
        return df.limit(0)
    if keep >= 1 or not found:
        return rows
    some = rows.where(side).withColumn("_quota", F.lit(max(1, round(found * keep)))).withColumn("_side", F.lit(1))
    return by_hash(some, ["_side"], "_quota", key, seed).select(df.columns).union(rows.where(~side))


def rows_for_each(most: int, symbols: int, low: int = 20_000, high: int = 100_000) -> int:
    """Rows that each symbol may give."""
    return max(low, min(high, most // max(1, symbols)))


def class_ratio(df: DataFrame, key: Column, most: int, ratio: float, label: str = "label", seed: str = "0") -> DataFrame:
    """At most ``most`` rows: positives up to most / (1 + ratio), and ``ratio`` negatives for each. No positives: no rows."""
    found = df.agg(F.count_if(F.col(label) >= 0.5).alias("p"), F.count_if(F.col(label) < 0.5).alias("n")).first()
    positives = min(found.p, int(most / (1 + ratio)))
    negatives = min(found.n, int(round(positives * ratio)))
    positive = F.col(label) >= 0.5
    rows = df.where(F.col(label).isNotNull()).withColumn("_side", positive.cast("int")).withColumn("_quota", F.when(positive, positives).otherwise(negatives))
    return by_hash(rows, ["_side"], "_quota", key, seed).drop("_side", "_quota")


def bin_quotas(counts: DataFrame, most: int, high: bool = True) -> DataFrame:
    """(bin, n, quota) from (bin, n): more for larger bins of weight, less than in proportion for crowded ones.

    Shares are (1 + 1.25 * place) * n ** 0.75; quotas are rounded by largest remainder and no more than n.
    """
    every = Window.partitionBy()
    place = (F.col("bin") - F.min("bin").over(every)) / F.greatest(F.max("bin").over(every) - F.min("bin").over(every), F.lit(1))
    share = (1 + 1.25 * (place if high else 1 - place)) * F.pow(F.col("n"), F.lit(0.75))
    rows = counts.withColumn("share", share).withColumn("exact", F.lit(float(most)) * F.col("share") / F.sum("share").over(every))
    rows = rows.withColumn("base", F.floor("exact")).withColumn("left", F.lit(most) - F.sum("base").over(every))
    rest = F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), "bin"))
    return rows.withColumn("quota", F.least(F.col("n"), F.col("base") + (rest <= F.col("left")).cast("int"))).select("bin", "n", "quota")


def topped_up(quotas: DataFrame, most: int) -> DataFrame:
    """(bin, n, quota): what quotas are short of ``most`` because bins are too small goes to those that have more, highest bin first."""
    spare = F.col("n") - F.col("quota")
    above = F.coalesce(F.sum(spare).over(Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = F.lit(most) - F.sum("quota").over(Window.partitionBy())
    return quotas.withColumn("more", F.greatest(F.lit(0), F.least(spare, short - above))).select("bin", "n", (F.col("quota") + F.col("more")).alias("quota"))


def by_weight_bin(df: DataFrame, key: Column, most: int, weight: str = "weight", step: float = 0.1, top: float = 7.0, high: bool = True, seed: str = "0", fill: bool = False) -> DataFrame:
    """A sample with a quota for each bin of weight; with ``fill`` there are ``most`` rows if the table has as many."""
    bins = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(weight))) / step + 1e-9).cast("long")
    rows = df.withColumn("bin", bins)
    quotas = bin_quotas(rows.groupBy("bin").agg(F.count("*").alias("n")), most, high)
    quotas = topped_up(quotas, most) if fill else quotas
    return by_hash(rows.join(quotas.select("bin", "quota"), "bin"), ["bin"], "quota", key, seed).drop("quota")


def weighted(df: DataFrame, key: Column, n: int, weight: str = "weight", seed: str = "0") -> DataFrame:
    """n rows without replacement, each draw in proportion to weight: the largest ln(u) / weight, u from a hash."""
    u = (F.conv(F.substring(drawn(key, seed), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    rows = df.where(F.col(weight) > 0).withColumn("_draw", F.log(u) / F.col(weight)).withColumn("_key", key).withColumn("_all", F.lit(1)).withColumn("_most", F.lit(n))
    step = F.floor(F.log2(F.greatest(-F.col("_draw"), F.lit(1e-300))) * 256)  # rises as draws fall
    return take(rows, ["_all"], "_most", [F.col("_draw").desc(), F.col("_key")], step).select(df.columns)


def balance_map(df: DataFrame, target: str, bins: int = 10, power: float = 1.0, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Adds ``balance``: (mean count / own count) ** (power / 2) of the quantile bin of the target, within bounds."""
    cuts = quantiles(df, target, [i / bins for i in range(1, bins)])
    if not cuts:
        return df.withColumn("balance", F.lit(1.0))
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(target)))
    rows = df.withColumn("_bin", place)
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("balance", F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.sqrt(F.avg("_n").over(Window.partitionBy()) / F.col("_n")), F.lit(power)))))
    return rows.join(counts.select("_bin", "balance"), "_bin").drop("_bin")


def class_weights(df: DataFrame, weight: str = "weight", label: str = "label", low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Adds ``balanced``: weights scaled so that the masses of both classes meet at their geometric mean; the mean weight stays."""
    m = df.agg(*(F.sum(F.when(test, F.col(weight))).alias(k) for k, test in (("p", F.col(label) >= 0.5), ("n", F.col(label) < 0.5))), F.avg(weight).alias("mean")).first()
    if not m.p or not m.n:
        return df.withColumn("balanced", F.col(weight))
    middle = (m.p * m.n) ** 0.5
    up, down = (max(low, min(high, middle / x)) for x in (m.p, m.n))
    scaled = F.col(weight) * F.when(F.col(label) >= 0.5, up).otherwise(down)
    keep = (m.p + m.n) / (m.p * up + m.n * down)
    return df.withColumn("balanced", scaled * keep)


def loss_weights(df: DataFrame, weight: str = "weight", label: str = "label", power_pos: float = 1.0, power_neg: float = 1.0, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """Adds ``loss_weight``: weights to a power by class, divided by the class's mean, within bounds."""
    positive = F.col(label) >= 0.5
    rows = df.withColumn("_p", F.pow(F.col(weight), F.when(positive, power_pos).otherwise(power_neg)))
    m = rows.agg(F.avg(F.when(positive, F.col("_p"))).alias("p"), F.avg(F.when(~positive, F.col("_p"))).alias("n")).first()
    scaled = F.col("_p") / F.when(positive, m.p or 1.0).otherwise(m.n or 1.0)
    return rows.withColumn("loss_weight", F.greatest(F.lit(low), F.least(F.lit(high), scaled))).drop("_p")


def weight_histogram(df: DataFrame, weight: str = "weight", label: str = "label", step: float = 1.0, bins: int = 8) -> DataFrame:
    """(bin, pos, neg, pos_mass, neg_mass) for every bin, empty ones too."""
    positive = F.col(label) >= 0.5
    rows = df.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col(weight) / step)).cast("int"))
    rows = rows.groupBy("bin").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"), F.sum(F.when(positive, F.col(weight)).otherwise(0.0)).alias("pos_mass"), F.sum(F.when(~positive, F.col(weight)).otherwise(0.0)).alias("neg_mass")
    )
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(rows, "bin", "left").na.fill(0)


def split_by_time(df: DataFrame, share: float = 0.8, ts: str = "ts") -> DataFrame:
    """Adds ``part``: train for the first share of rows in time, then val; rows at the same time stay together.

    Rows are counted by day, and by time in the one day that the cut falls in. Rows without a time are val.
    """
    day = F.date_trunc("day", F.col(ts))
    past = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = df.where(F.col(ts).isNotNull()).groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    found = days.where((F.col("_before") < share * F.col("_all")) & (F.col("_before") + F.col("_n") >= share * F.col("_all"))).first()
    if found is None:
        return df.withColumn("part", F.lit("train"))
    inside = df.where(day == F.lit(found._day)).groupBy(ts).agg(F.count("*").alias("_n"))
    before = F.lit(found._before) + F.coalesce(F.sum("_n").over(Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("_before", before).where(F.col("_before") < share * found._all).agg(F.max(ts)).first()[0]
    return df.withColumn("part", F.when(F.col(ts) <= F.lit(cut), "train").otherwise("val"))


def purge(df: DataFrame, cutoff: str, horizon_seconds: int, ts: str = "ts") -> DataFrame:
    """Rows whose labels are settled before the cutoff."""
    return df.where(F.col(ts) <= F.lit(cutoff).cast("timestamp_ntz") - F.expr(f"INTERVAL {horizon_seconds} SECONDS"))


def rank_group(ts: Column, symbol_id: Column, minutes: int = 4320) -> Column:
    """The group that a row is ranked in: its symbol and its stretch of time."""
    return symbol_id * 1_000_000 + F.floor(F.unix_timestamp(ts.cast("timestamp")) / 60 / minutes)


def positive_rate(df: DataFrame, label: str = "label", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.where(F.col(label).isNotNull()).agg((F.sum(w * F.col(label)) / F.sum(w)).alias("positive_rate"))


def pool_slice(pool: DataFrame, key: Column, cutoff: str, most: int, ratio: float, horizon_seconds: int = 0, ts: str = "ts", seed: str = "0") -> DataFrame:
    """What a model trained up to a cutoff may see of a pool of rows, with its classes in ratio again."""
    return class_ratio(purge(pool, cutoff, horizon_seconds, ts), key, most, ratio, seed=seed)


def balanced(df: DataFrame, key: Column, target: str, n: int, bins: int = 10, seed: str = "0") -> DataFrame:
    """n rows for a regression, the more likely the rarer their stretch of the target is and the more they weigh."""
    rows = balance_map(df, target, bins)
    rows = rows.withColumn("_w", F.col("balance") * F.col("weight"))
    return weighted(rows, key, n, "_w", seed).drop("_w")


def bottom_pool(rows: DataFrame, key: Column, cutoffs: list[str], most: int, ratio: float, horizon_seconds: int = 0, ts: str = "ts", label: str = "label", seed: str = "0") -> DataFrame:
    """A pool that is sampled once, from which ``from_pool`` cuts the sample of every cutoff without reading ``rows`` again.

    Of each class and stretch between cutoffs, those rows are kept whose hashes are smallest, as many as any sample may
    take, with how many rows there were (``_total``). Smallest hashes of stretches together are those of their union, so
    pools of more rows can be merged. Rows without a label or time, or settled after the last cutoff, are not in it.
    """
    ends = sorted(cutoffs)
    settled = F.expr(f"INTERVAL {horizon_seconds} SECONDS")
    late = lambda c: (F.col(ts) > F.lit(c).cast("timestamp_ntz") - settled).cast("int")
    stretch = sum((late(c) for c in ends[1:]), late(ends[0]))
    side = (F.col(label) >= 0.5).cast("int")
    known = rows.where(F.col(label).isNotNull() & F.col(ts).isNotNull()).withColumns({"_stretch": stretch, "_side": side, "_hash": drawn(key, seed)}).where(F.col("_stretch") < len(ends))
    counts = known.groupBy("_stretch", "_side").agg(F.count("*").alias("_total"))
    positives = int(most / (1 + ratio))
    quota = F.when(F.col("_side") == 1, positives).otherwise(int(round(positives * ratio)))
    kept = by_hash(known.withColumn("_quota", quota), ["_stretch", "_side"], "_quota", key, seed).drop("_quota")
    return kept.join(counts, ["_stretch", "_side"])


def from_pool(pool: DataFrame, cutoffs: list[str], cutoff: str, key: Column, most: int, ratio: float, seed: str = "0") -> DataFrame:
    """The rows that ``pool_slice`` draws from all rows for one of the pool's cutoffs, drawn from the pool."""
    seen = pool.where(F.col("_stretch") <= sorted(cutoffs).index(cutoff))
    totals = {r._side: r.n for r in seen.select("_stretch", "_side", "_total").distinct().groupBy("_side").agg(F.sum("_total").alias("n")).collect()}
    positives = min(totals.get(1, 0), int(most / (1 + ratio)))
    negatives = min(totals.get(0, 0), int(round(positives * ratio)))
    asked = seen.withColumn("_quota", F.when(F.col("_side") == 1, positives).otherwise(negatives))
    return by_hash(asked, ["_side"], "_quota", key, seed).drop("_stretch", "_side", "_hash", "_total", "_quota")
