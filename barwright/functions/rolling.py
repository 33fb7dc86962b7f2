"""Rolling and recursive indicators over ordered bars."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .scalars import col


def by(*keys: str, order: str) -> object:
    return Window.partitionBy(*keys).orderBy(order)


def full_mean(c: str | Column, w, n: int) -> Column:
    """Mean of the last n rows; NULL until n values are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(f) == n, F.avg(col(c)).over(f))


def full_std(c: str | Column, w, n: int) -> Column:
    """Population standard deviation of the last n rows; NULL until n values are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(f) == n, F.stddev_pop(col(c)).over(f))


def true_range(high: str | Column, low: str | Column, prev: str | Column, *, first: bool = False) -> Column:
    """Largest of high - low and the distances to the previous close. Without a previous close it is NULL, or
    high - low if `first`."""
    h, lo, p = col(high), col(low), col(prev)
    tr = F.greatest(h - lo, F.abs(h - p), F.abs(lo - p))
    return tr if first else F.when(p.isNotNull() & h.isNotNull() & lo.isNotNull(), tr)


def ema_array(values: str | Column, span: int, *, missing: str = "keep") -> Column:
    """Exponential mean of each place of an array, seeded with its first value (weights 2 / (span + 1)).

    missing: `keep` carries the last mean over NULLs, `reset` gives NULL there and starts anew behind.
    """
    a = 2.0 / (span + 1)
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    if missing == "keep":
        step = lambda acc, v: F.coalesce(F.lit(a) * v + F.lit(1 - a) * last(acc), last(acc), v)
    else:
        step = lambda acc, v: F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.lit(a) * v + F.lit(1 - a) * last(acc), v))
    return F.aggregate(col(values), F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(step(acc, v))))


def drawdown(values: Column) -> Column:
    """Largest fall from a running maximum, as a share of it; NULL with fewer than two values."""
    got = F.filter(values, lambda x: x.isNotNull())
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("fall"))
    fold = F.aggregate(got, start, lambda acc, x: F.struct(F.greatest(acc["peak"], x).alias("peak"), F.greatest(acc["fall"], F.lit(1.0) - F.try_divide(x, F.greatest(acc["peak"], x))).alias("fall")), lambda acc: acc["fall"])
    return F.when(F.size(got) >= 2, fold)
