"""Windows over the rows of a symbol's segment, in order of time.

Windows are counted in rows, as gaps in time don't shrink them. A value is null until ``minp`` rows of its frame are not
null; a null is skipped, it doesn't spoil what comes after it.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "seg")
#: Keeps quotients finite.
EPS = 1e-9


def ordered(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def frame(n: int, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The row and the n - 1 before it."""
    return ordered(keys).rowsBetween(-(n - 1), 0)


def so_far(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return ordered(keys).rowsBetween(Window.unboundedPreceding, 0)


def ahead(first: int, last: int, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """Rows ``first`` to ``last`` after the row; at the end of a segment as many as there are."""
    return ordered(keys).rowsBetween(first, last)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: by 0 infinite, or NaN if both are 0, where Spark's own quotient is null or an error."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def gate(value: Column, x: Column, n: int, minp: int | None) -> Column:
    return F.when(F.count(x).over(frame(n)) >= (n if minp is None else minp), value)


def mean(x: str | Column, n: int, minp: int | None = None) -> Column:
    return gate(F.avg(col(x)).over(frame(n)), col(x), n, minp)


def total(x: str | Column, n: int, minp: int | None = None) -> Column:
    return gate(F.sum(col(x)).over(frame(n)), col(x), n, minp)


def deviation(x: str | Column, n: int, minp: int | None = None) -> Column:
    """Of the population."""
    return gate(F.stddev_pop(col(x)).over(frame(n)), col(x), n, minp)


def lowest(x: str | Column, n: int, minp: int | None = None) -> Column:
    return gate(F.min(col(x)).over(frame(n)), col(x), n, minp)


def highest(x: str | Column, n: int, minp: int | None = None) -> Column:
    return gate(F.max(col(x)).over(frame(n)), col(x), n, minp)


def since_lowest(x: str, n: int, minp: int | None = None) -> Column:
    """Rows since the least value of the frame, the latest of equal ones. Needs a column ``rn``, the row's number."""
    at = F.min(F.struct(col(x).alias("x"), (-F.col("rn")).alias("rn"))).over(frame(n))["rn"]
    return gate(F.col("rn") + at, col(x), n, minp)


def since_highest(x: str, n: int, minp: int | None = None) -> Column:
    at = F.max(F.struct(col(x).alias("x"), F.col("rn").alias("rn"))).over(frame(n))["rn"]
    return gate(F.col("rn") - at, col(x), n, minp)


def before(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(ordered())


def true_range() -> Column:
    """The widest of high to low and either to the close before; the first close stands in for the one before it."""
    last = F.coalesce(before("close"), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def slope(x: str, n: int) -> Column:
    """Percent a row over the last n rows of a logarithm, or over as many as there are."""
    first = F.first(col(x)).over(so_far())
    back = F.least(F.lit(n), F.col("rn") - 1)
    return F.when(F.col("rn") > 1, (col(x) - F.coalesce(before(x, n), first)) / F.nullif(back, F.lit(0)) * 100)


def path(x: str, n: int) -> Column:
    """The sum of absolute steps in the frame; the first row has none."""
    return gate(F.sum(f"{x}_step").over(frame(n)), F.col(f"{x}_step"), n, None)


def residual_error(x: str, n: int) -> Column:
    """Root mean square of what a straight line over the frame leaves of ``x``."""
    at, y = F.col("rn").cast("double"), col(x)
    sxx, syy, sxy = F.regr_sxx(y, at).over(frame(n)), F.regr_syy(y, at).over(frame(n)), F.regr_sxy(y, at).over(frame(n))
    return gate(F.sqrt(F.greatest(F.lit(0.0), syy - F.try_divide(sxy * sxy, sxx)) / n), y, n, None)


def efficiency(x: str, n: int) -> Column:
    """How far ``x`` came over the frame against how far it went; 0 if it did not move."""
    went = F.sum(f"{x}_step").over(ordered().rowsBetween(-(n - 2), 0))
    came = F.abs(col(x) - F.first(col(x)).over(frame(n)))
    return F.when(F.col("rn") >= max(2, n), F.when(went <= 1e-12, F.lit(0.0)).otherwise(came / F.nullif(went, F.lit(0.0))))


def run(flag: str) -> Column:
    """How many rows up to this one are true in a row."""
    broken = F.max(F.when(~F.col(flag), F.col("rn"))).over(so_far())
    return F.col("rn") - F.coalesce(broken, F.lit(0))


def since_true(flag: str) -> Column:
    """Rows since the last true one; counted from the start of the segment before the first."""
    return F.col("rn") - F.coalesce(F.max(F.when(F.col(flag), F.col("rn"))).over(so_far()), F.lit(0))


def clip(x: Column, low: float, high: float) -> Column:
    """Between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def yes(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))
