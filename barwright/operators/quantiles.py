"""Exact quantiles of many columns at once by distributed selection."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import no_nan
from ..sources.shared import written

MOST = 4_096  # values between two bounds that are ordered at last, of each column and rank
ACCURACY = 5_000


@dataclass(frozen=True)
class _Wanted:
    """The rank (from 0) of a column that lies strictly between two values, and how many values lie at or below the lower."""

    name: str
    column: int
    rank: int
    low: float | None
    high: float | None
    below: int
    inside: int


def _between(melted: DataFrame, wanted: list[_Wanted]) -> DataFrame:
    """(target, v): the values strictly between the bounds of each target; targets are few and broadcast."""
    kind = "target int, c int, low double, high double"
    table = melted.sparkSession.createDataFrame([(i, w.column, w.low, w.high) for i, w in enumerate(wanted)], kind)
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    return melted.join(F.broadcast(table), "c").where(inside).select("target", "v")


def _narrowed(melted: DataFrame, wanted: list[_Wanted], accuracy: int) -> tuple[list[_Wanted], dict[str, float]]:
    """Each target between closer bounds, or its value if a bound is it: approximate quantiles around the rank give two
    values, and the rows at, below and between them are counted, so that nothing depends on how good they are."""
    share = [(w.rank - w.below) / max(1, w.inside - 1) for w in wanted]
    points = sorted({min(1.0, max(0.0, p + e / accuracy)) for p in share for e in (-2, 2)})  # one list for all targets
    found = _between(melted, wanted).groupBy("target").agg(F.percentile_approx("v", points, accuracy).alias("q")).collect()
    place = lambda p, e: points.index(min(1.0, max(0.0, p + e / accuracy)))
    cut = {r.target: (r.q[place(share[r.target], -2)], r.q[place(share[r.target], 2)]) for r in found}
    table = melted.sparkSession.createDataFrame([(t, a, b) for t, (a, b) in cut.items()], "target int, a double, b double")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    counts = _between(melted, wanted).join(F.broadcast(table), "target").groupBy("target").agg(F.count_if(v < a).alias("lt"), F.count_if(v == a).alias("at_a"), F.count_if((v > a) & (v < b)).alias("mid"), F.count_if((v == b) & (b > a)).alias("at_b")).collect()
    left, done = [], {}
    for r in counts:
        w, (a, b) = wanted[r.target], cut[r.target]
        k = w.rank - w.below
        if k < r.lt:
            left.append(replace(w, high=a, inside=r.lt))
        elif k < r["lt"] + r.at_a:
            done[w.name] = a
        elif k < r["lt"] + r.at_a + r.mid:
            left.append(replace(w, low=a, high=b, below=w.below + r["lt"] + r.at_a, inside=r.mid))
        elif k < r["lt"] + r.at_a + r.mid + r.at_b:
            done[w.name] = b
        else:
            skipped = r["lt"] + r.at_a + r.mid + r.at_b
            left.append(replace(w, low=b, below=w.below + skipped, inside=w.inside - skipped))
    return left, done


def _ordered(melted: DataFrame, wanted: list[_Wanted]) -> dict[str, float]:
    """Values of targets with few values between their bounds: equal ones are counted first, then ranked by target."""
    rows = _between(melted, wanted).groupBy("target", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("target").orderBy("v"))
    ranks = melted.sparkSession.createDataFrame([(i, w.rank - w.below) for i, w in enumerate(wanted)], "target int, rank long")
    rows = rows.withColumn("upto", upto).join(F.broadcast(ranks), "target").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return {wanted[r.target].name: r.v for r in rows.collect()}


def quantiles(df: DataFrame, columns: list[str], probs: list[float], *, most: int = MOST, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The exact quantiles of each column, interpolated linearly between neighbours; None for a column without values. NULL
    and NaN don't count.

    The columns are written once. Each pass brackets every wanted rank by two approximate quantiles of the values that
    are still in question, and counts exactly what lies below, at and between them: some 1,000 times fewer values are
    left after each, until `most` can be ordered. A pass is two aggregations for all columns; a task holds sketches, the
    driver bounds and counts. Many equal values end a search at once, since a bound that holds the rank is the answer.
    """
    table = written(df.select(*(no_nan(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns))))
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in range(len(columns)))))
    melted = table.select(pairs.alias("x")).select("x.c", "x.v").where("v is not null")
    n = table.agg(*(F.count(f"c{i}").alias(f"c{i}") for i in range(len(columns)))).first()
    at = {}
    for i in range(len(columns)):
        for p in probs:
            if n[i]:
                h = p * (n[i] - 1)
                at[i, p] = (math.floor(h), math.ceil(h), h - math.floor(h))
    ranks = sorted({(i, k) for (i, _), (a, b, _) in at.items() for k in (a, b)})
    wanted, values = [_Wanted(f"{i}:{k}", i, k, None, None, 0, n[i]) for i, k in ranks], {}
    while wanted:
        few, wanted = [w for w in wanted if w.inside <= most], [w for w in wanted if w.inside > most]
        if few:
            values |= _ordered(melted, few)
        if wanted:
            wanted, done = _narrowed(melted, wanted, accuracy)
            values |= done

    def value(i: int, p: float) -> float | None:
        if (i, p) not in at:
            return None
        a, b, part = at[i, p]
        x, y = values[f"{i}:{a}"], values[f"{i}:{b}"]
        return x if part == 0 or x == y else x + (y - x) * part

    return {c: [value(i, p) for p in probs] for i, c in enumerate(columns)}
