"""Normalisation of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

COLUMNS = ("open", "high", "low", "close", "volume")


def of_sample():
    return Window.partitionBy("sample_id")


def zscore(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Each value less the mean of its window, in population standard deviations (0 counts as 1)."""
    def z(c):
        sd = F.stddev_pop(c).over(of_sample())
        return (F.col(c) - F.avg(c).over(of_sample())) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd)
    return rows.withColumns({c: z(c) for c in columns})


def robust(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Each value less the median of its window, in 1.4826 median absolute deviations (0 counts as 1)."""
    med = rows.groupBy("sample_id").agg(*(F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns))
    rows = rows.join(med, "sample_id")
    mad = rows.groupBy("sample_id").agg(*((F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5) * 1.4826).alias(f"_d_{c}") for c in columns))
    rows = rows.join(mad, "sample_id")
    out = rows.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.coalesce(F.col(f"_d_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_d_{c}")) for c in columns})
    return out.drop(*(f"_m_{c}" for c in columns), *(f"_d_{c}" for c in columns))


def returns_relative(rows: DataFrame, order: str = "t") -> DataFrame:
    """Prices over the previous close less 1, and ln(1 + volume)."""
    prev = F.lag("close").over(of_sample().orderBy(order))
    return rows.withColumns({**{c: ratio(F.col(c), prev) - 1 for c in ("open", "high", "low", "close")}, "volume": F.log1p(F.col("volume").cast("double"))})


def fit_global(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row with mean_<c> and std_<c> over all rows; a variance is 1e-12 at least."""
    def var(c):
        m = F.avg(F.col(c).cast("double"))
        return F.sqrt(F.greatest(F.avg(F.col(c).cast("double") * F.col(c)) - m * m, F.lit(1e-12)))
    return rows.agg(*(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns), *(var(c).alias(f"std_{c}") for c in columns))


def apply_global(rows: DataFrame, fit: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    out = rows.crossJoin(F.broadcast(fit))
    return out.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}).select(rows.columns)
