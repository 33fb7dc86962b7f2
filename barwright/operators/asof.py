"""As-of joins by a two-level scan, so that a hot key isn't one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import place_in
from ..functions.scalars import col


def order_number(df: DataFrame, c: str | Column) -> Column:
    """A date's days, a timestamp's microseconds, a boolean or number as it is: what keeps the order and can be subtracted."""
    kind = df.select(col(c)).dtypes[0][1]
    if kind == "date":
        return F.unix_date(col(c)).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(col(c).cast("timestamp")).cast("double") / 1e6
    return col(c).cast("double")


def time_cuts(places: DataFrame, at: str, ranges: int | None = None) -> list[float]:
    """Cuts of a numeric column into `ranges` (shuffle partitions by default) spans of about equal row counts."""
    n = ranges or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = places.agg(F.percentile_approx(at, [i / n for i in range(1, n)])).first()[0] if n > 1 else []
    return sorted(set(cuts or []))


def asof_join(probes: DataFrame, observations: DataFrame, by: list[str], probe_time: str, obs_time: str, values: list[str], *, strict: bool = True, forward: bool = False, tolerance: float | None = None, ranges: int | None = None) -> DataFrame:
    """probes with the `values` of the latest observation of the same keys `by` before probe_time (the next one behind it if
    `forward`); an equal time counts unless `strict`. Of observations of one key and time the one with the largest values counts.

    tolerance: the farthest an observation may lie, in the unit of the times (days of dates, seconds of timestamps). Probes
    without one, or with a null key or time, get NULLs; every probe stays, repeated ones too. Columns of `values` must not be
    among those of probes.

    Two levels: times are cut to spans of about equal row counts. Within each (key, span) a window carries the last
    observation to the probes behind it; the last one of each span is carried to the spans behind it by a small table of
    (key, span). A key with most of the rows is so dealt to as many tasks as there are spans.
    """
    clash = {c.lower() for c in values} & {c.lower() for c in probes.columns}
    if clash:
        raise ValueError(f"probes have columns named as values: {sorted(clash)}")
    sign = -1.0 if forward else 1.0
    keys = [f"_k{i}" for i in range(len(by))]
    at = lambda df, c: (order_number(df, c) * sign).alias("_at")
    named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    obs = observations.select(*named, at(observations, obs_time), F.struct(*values).alias("_v")).where(F.col("_at").isNotNull())
    obs = obs.dropna(subset=keys).groupBy(*keys, "_at").agg(F.max("_v").alias("_v")).withColumn("_v", F.struct("_at", "_v"))
    ask = probes.select(*named, at(probes, probe_time), F.struct(*probes.columns).alias("_p"))
    # Before equal times if strict, else behind them.
    rows = obs.select(*keys, "_at", F.lit(1).alias("_side"), "_v", F.lit(None).cast(ask.schema["_p"].dataType).alias("_p")).unionByName(ask.withColumn("_side", F.lit(0 if strict else 2)).withColumn("_v", F.lit(None).cast(obs.schema["_v"].dataType)))
    cuts = time_cuts(rows.select("_at"), "_at", ranges)
    rows = rows.withColumn("_span", place_in(cuts, F.col("_at"), "double"))
    lasts = rows.groupBy(*keys, "_span").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_span", F.last("_l", ignorenulls=True).over(before).alias("_c"))
    line = Window.partitionBy(*keys, "_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_f", F.last("_v", ignorenulls=True).over(line)).where(F.col("_p").isNotNull())
    found = found.join(carried, [*keys, "_span"], "left").withColumn("_f", F.coalesce("_f", "_c"))
    near = F.col("_at").isNotNull()
    if tolerance is not None:
        near &= F.col("_at") - F.col("_f._at") <= float(tolerance)
    return found.withColumn("_f", F.when(near, F.col("_f._v"))).select("_p.*", *(F.col(f"_f.{c}").alias(c) for c in values))
