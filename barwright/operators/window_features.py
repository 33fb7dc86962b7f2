"""Features of sample windows: tabular, shape, pooled statistics, imputation and generated variants.

All features of a sample come from one exchange by sample_id: a window gives previous closes, then conditional
aggregates over ranges of t, and array folds where a value depends on the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import drawdown, ema_array, true_range
from ..functions.scalars import log_ratio, no_nan, ratio
from .quantiles import quantiles

def by_t():
    return Window.partitionBy("sample_id").orderBy("t")



@dataclass(frozen=True)
class TabularSpec:
    """size: rows of a window, the last one being the decision bar, of which only `open` is used."""

    size: int = 60
    horizons: tuple[int, ...] = (5, 10, 20, 40)
    atr: tuple[int, int] = (14, 50)
    means: tuple[int, ...] = (20, 50)
    ema: int = 20
    look: int = 10
    edge: int = 3
    volume: tuple[int, ...] = (10, 20)


def tabular(rows: DataFrame, spec: TabularSpec | None = None, *, folds: bool = True) -> DataFrame:
    """One row of features for each sample. `folds` adds the ones that need folds (exponential means, drawdowns)."""
    s = spec or TabularSpec()
    last = s.size - 2
    rows = rows.withColumn("tr", true_range("high", "low", F.lag("close").over(by_t()))).withColumn("top", F.greatest("open", "close")).withColumn("bottom", F.least("open", "close"))
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    back = lambda c, k, upto=last: F.when(F.col("t").between(s.size - 1 - k, upto), c if isinstance(c, Column) else F.col(c))
    at = lambda c, t: F.max(F.when(F.col("t") == t, F.col(c)))
    aggs: dict[str, Column] = {"p": at("open", s.size - 1), "c1": at("close", last), "h1": at("high", last), "l1": at("low", last), "v1": at("volume", last)}
    for n, k in zip(("short", "long"), s.atr, strict=True):
        aggs[f"atr_{n}"] = F.avg(F.when(F.col("t") >= 1, back("tr", k)))
    for k in s.means:
        aggs[f"mean{k}"], aggs[f"std{k}"] = F.avg(back("close", k)), F.stddev_pop(back("close", k))
    for h in s.horizons:
        first, fin = (s.size - 1 - h, s.size - 2 - h + s.edge), (last - s.edge + 1, last)
        mean_in = lambda c, r: F.avg(F.when(F.col("t").between(*r), F.col(c)))
        body = F.abs(F.col("close") - F.col("open")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
        aggs |= {
            f"close_{h}": at("close", s.size - 1 - h), f"high_{h}": F.max(back("high", h)), f"low_{h}": F.min(back("low", h)),
            f"upper_wick_mean_{h}": F.avg(back(F.when(whole, F.col("high") - F.col("top")), h)), f"lower_wick_mean_{h}": F.avg(back(F.when(whole, F.col("bottom") - F.col("low")), h)), f"body_pct_range_mean_{h}": F.avg(back(F.when(whole, body), h)),
            f"dh_{h}": mean_in("high", fin) - mean_in("high", first), f"dl_{h}": mean_in("low", fin) - mean_in("low", first),
            f"q90_{h}": F.percentile(back("high", h), 0.9), f"q10_{h}": F.percentile(back("low", h), 0.1),
        }
    for k in s.volume:
        aggs[f"vmed_{k}"] = F.percentile(back("volume", k).cast("double"), 0.5)
    if folds:
        aggs["closes"] = F.transform(F.array_sort(F.collect_list(F.struct("t", no_nan("close").alias("c")))), lambda x: x["c"])
    g = rows.groupBy("sample_id").agg(*(v.alias(f"_{k}") for k, v in aggs.items()))
    c = lambda name: F.col(f"_{name}")
    g = g.withColumn("_atrl", F.when(c("atr_long") > 0, c("atr_long")))
    out: dict[str, Column] = {"atr_short": c("atr_short"), "atr_long": c("atr_long"), "atr_short_over_long": ratio(c("atr_short"), c("atrl"))}
    gap = F.when((c("p") > 0) & (c("c1") > 0), c("p") / c("c1") - 1)
    out |= {"gap_pct": gap, "gap_vs_atr": ratio(c("p") - c("c1"), c("atrl")), "gap_direction": F.signum(gap), "prev_day_range_pct": ratio(c("h1") - c("l1"), c("c1"))}
    for k in s.means:
        out |= {f"dist_ma{k}_atr": ratio(c("p") - c(f"mean{k}"), c("atrl")), f"dist_ma{k}_z": ratio(c("p") - c(f"mean{k}"), c(f"std{k}"))}
    for h in s.horizons:
        span = c(f"high_{h}") - c(f"low_{h}")
        width = ratio(c(f"q90_{h}") - c(f"q10_{h}"), c("atrl"))
        out |= {f"return_log_{h}": log_ratio(c("p"), c(f"close_{h}")), f"range_atr_{h}": ratio(span, c("atrl")), f"retrace_pct_{h}": (c(f"high_{h}") - c("p")) / F.greatest(span, F.lit(1e-12))}
        out |= {k: c(k) for k in (f"upper_wick_mean_{h}", f"lower_wick_mean_{h}", f"body_pct_range_mean_{h}")}
        out |= {f"channel_slope_high_atr_{h}": ratio(c(f"dh_{h}") / max(h - 1, 1), c("atrl")), f"channel_slope_low_atr_{h}": ratio(c(f"dl_{h}") / max(h - 1, 1), c("atrl")), f"channel_width_atr_{h}": width}
    if {20, 40} <= set(s.horizons):
        out["channel_width_contraction_20_over_40"] = ratio(c("q90_20") - c("q10_20"), c("q90_40") - c("q10_40"))
    for k in s.volume:
        out[f"volume_shock_{k}"] = F.when(c(f"vmed_{k}") > 0, c("v1") / c(f"vmed_{k}"))
    if folds:
        g = g.withColumn("_ema", ema_array("_closes", s.ema, missing="reset"))
        e1, e2 = F.get(F.col("_ema"), F.lit(last)), F.get(F.col("_ema"), F.lit(last - s.look))
        out |= {f"ema{s.ema}_slope_atr": ratio((e1 - e2) / s.look, c("atrl")), f"close_vs_ema{s.ema}_atr": ratio(c("c1") - e1, c("atrl"))}
        for h in s.horizons:
            out[f"max_drawdown_{h}"] = drawdown(F.slice(c("closes"), max(1, s.size - h), h))
    return g.select("sample_id", *(v.alias(k) for k, v in out.items()))


def shape(rows: DataFrame, *, pos: bool = True, span: int = 20) -> DataFrame:
    """Each row's log shape: r, rr, u, l, body, logv, and pos = (close - EMA) / ATR, the ATR being an EMA of the true
    range (both carry over missing values)."""
    top = F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), F.greatest("open", "close"))
    low = F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), F.least("open", "close"))
    prev = F.lag("close").over(by_t())
    out = rows.select("sample_id", "t", "close", log_ratio(F.col("close"), prev).alias("r"), log_ratio("high", "low").alias("rr"), log_ratio(F.col("high"), top).alias("u"), log_ratio(low, F.col("low")).alias("l"), log_ratio(top, low).alias("body"), F.when(F.col("volume") >= 0, F.log1p(F.col("volume").cast("double"))).alias("logv"), F.when(F.col("high") >= F.col("low"), true_range("high", "low", prev, first=True)).alias("tr"))
    if not pos:
        return out.drop("close", "tr")
    kept = ("t", "close", "r", "rr", "u", "l", "body", "logv", "tr")
    a = out.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("b"))
    a = a.select("sample_id", "b", ema_array(F.col("b.close"), span).alias("e"), ema_array(F.col("b.tr"), span).alias("a"))
    z = a.select("sample_id", F.explode(F.arrays_zip("b", "e", "a")).alias("z")).select("sample_id", "z.b.*", "z.e", "z.a")
    return z.withColumn("pos", F.when(F.col("a") > 0, (F.col("close") - F.col("e")) / F.col("a"))).drop("close", "tr", "e", "a")


def pooled(rows: DataFrame, columns: tuple[str, ...], key: str = "sample_id", t: str = "t") -> DataFrame:
    """Mean, standard deviation, least, largest, last valid value and slope of each column over a window."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.max_by(x, F.when(x.isNotNull(), F.col(t))).alias(f"{c}_last"), F.regr_slope(x, F.col(t).cast("double")).alias(f"{c}_slope")]
    return rows.groupBy(key).agg(*aggs)


def impute_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column; 0 for a column without values. No task holds a column (quantiles)."""
    found = quantiles(df, columns, [0.5])
    return df.sparkSession.createDataFrame([tuple(found[c][0] if found[c][0] is not None else 0.0 for c in columns)], ", ".join(f"`{c}` double" for c in columns))


def impute(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, NaN and infinite values become the fitted medians."""
    fit = fit.select(*(F.col(c).alias(f"_{c}") for c in columns))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), F.col(c))
    return df.crossJoin(F.broadcast(fit)).withColumns({c: F.coalesce(finite(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash: the same for the same parts in every run."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def normal(*parts) -> Column:
    """A standard normal number from hashes (Box and Muller)."""
    u, v = uniform(F.lit("u"), *parts), uniform(F.lit("v"), *parts)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)


def augment(rows: DataFrame, columns: tuple[str, ...], *, seed: int = 1, crops: tuple[int, ...] = (64, 96), sigma: float = 0.0, drop: float = 0.0, censor: float = 0.0, modes: tuple[str, ...] = ("time",), mask_time: float = 0.15, mask_feature: float = 0.15) -> DataFrame:
    """Variants of windows for training; all random numbers are hashes of seed and place.

    crops: one of the lengths that fit is drawn for all windows, and a start for each; t counts from 0 again and `crop`
    is the length (no length fits: windows stay whole). sigma: Gaussian noise is added to what is there. drop: each column is
    left out of all windows with this probability. censor: the last row of a window is emptied with this probability.
    masked_<column> marks values to predict among those that are there: whole rows by `time`, single values by `feature`.
    """
    s = F.lit(seed)
    size = F.max("t").over(Window.partitionBy("sample_id")) + 1
    rows = rows.withColumn("_size", size)
    fits = F.filter(F.array(*(F.lit(c) for c in crops)), lambda c: (c > 0) & (c <= F.col("_size")))
    pick = F.get(fits, F.floor(uniform(s, F.lit("length")) * F.size(fits)).cast("int"))
    rows = rows.withColumn("crop", F.coalesce(pick, F.col("_size")).cast("int"))
    start = F.floor(uniform(s, F.lit("start"), "sample_id") * (F.col("_size") - F.col("crop") + 1))
    rows = rows.withColumn("t", (F.col("t") - start).cast("int")).where("t >= 0 and t < crop").drop("_size")
    last = (F.col("t") == F.col("crop") - 1) & (uniform(s, F.lit("censor"), "sample_id") < censor)
    there = lambda c: (uniform(s, F.lit(f"drop-{c}")) >= drop) & ~last
    rows = rows.withColumns({c: F.when(there(c), F.col(c) + F.lit(float(sigma)) * normal(s, F.lit(c), "sample_id", "t") if sigma > 0 else F.col(c)) for c in columns})
    both = "both" in modes
    by_time = (uniform(s, F.lit("mask"), "sample_id", "t") < mask_time) if both or "time" in modes else F.lit(False)
    by_value = lambda c: (uniform(s, F.lit(f"mask-{c}"), "sample_id", "t") < mask_feature) if both or "feature" in modes else F.lit(False)
    return rows.withColumns({f"masked_{c}": F.col(c).isNotNull() & (by_time | by_value(c)) for c in columns})
