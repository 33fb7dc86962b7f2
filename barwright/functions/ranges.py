"""Places of keys among sorted cuts, as expressions whose size doesn't grow with the number of cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place_in(cuts: list, key: Column, kind: str = "bigint") -> Column:
    """Number of cuts (ascending) that aren't above key: first among every m-th one, then among the m behind it."""
    if not cuts:
        return F.lit(0)
    m = max(1, round(len(cuts) ** 0.5))
    array = lambda xs: F.lit(list(xs)).cast(f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = below(array(cuts[::m]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * m + below(F.slice(array(cuts), (coarse - 1) * m + 1, F.lit(m))))


def range_of(df: DataFrame, key: Column, kind: str = "double") -> Column:
    """Number of the range of key, as many ranges as shuffle partitions and of about equal row counts; 0 for a null key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5])).first()[0] or []
    return F.when(key.isNull(), 0).otherwise(place_in(sorted(set(cuts)), key, kind))
