"""Pattern candidates in the last bars of each ticker's window of exactly `size` rows.

Indicators are computed inside the window, so its first rows have none. Windows by ticker need one exchange, which the
folds for exponential means share; parameters are exploded, never joined pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ema_array, full_mean, full_std, true_range
from ..functions.scalars import clean_token, ratio
from ..sources.shared import written

LOOK = 7
GAPS, VOLUMES, GAP_LENGTHS = (0.02, 0.04, 0.06), (2.0, 3.0, 5.0), (8, 16, 32, 64)
Z_WINDOWS, Z_LEVELS, Z_LENGTHS = (20, 50), (1.5, 2.0, 3.0), (16, 32, 64)
PULLBACKS, PIVOT_LENGTHS = (1, 2, 3, 4), (8, 16, 24, 32)
FLAG_LENGTHS, IMPULSE = (10, 20, 30, 40, 60), 5


def by_t():
    return Window.partitionBy("ticker").orderBy("t")


def indicators(last: DataFrame, size: int = 100) -> DataFrame:
    """Rows (ticker, t, date, asof_date, OHLCV, indicators) of tickers with exactly `size` rows; last is last_n's."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    rows = last.withColumn("_n", n).where(F.col("_n") == size).withColumn("t", (F.lit(size) - F.col("rn")).cast("int"))
    bars = F.array_sort(F.collect_list(F.struct("t", "date", "open", "high", "low", "close", "volume"))).alias("b")
    a = rows.groupBy("ticker").agg(bars, F.max("date").alias("asof_date"))
    a = a.select("ticker", "asof_date", "b", ema_array(F.col("b.close"), 10).alias("e10"), ema_array(F.col("b.close"), 20).alias("e20"))
    z = a.select("ticker", "asof_date", F.explode(F.arrays_zip("b", "e10", "e20")).alias("z")).select("ticker", "asof_date", "z.b.*", F.when(F.col("z.b.t") >= 9, F.col("z.e10")).alias("ma10"), F.when(F.col("z.b.t") >= 19, F.col("z.e20")).alias("ma20"))
    z = z.withColumn("prev", F.lag("close").over(by_t())).withColumn("tr", true_range("high", "low", "prev"))
    z = z.withColumns({"atr5": full_mean("tr", by_t(), 5), "atr14": full_mean("tr", by_t(), 14), "atr20": full_mean("tr", by_t(), 20), "vol20": full_mean("volume", by_t(), 20), "sd20": full_std("close", by_t(), 20), "sd50": full_std("close", by_t(), 50)})
    return z.withColumns({"vol_ratio": ratio("volume", "vol20"), "atr_ratio": ratio("atr5", "atr20"), "end_offset": F.lit(size - 1) - F.col("t")})


def _emit(rows: DataFrame, family: str, template: str, lengths: tuple[int, ...], variant: Column, extra: dict[str, Column]) -> DataFrame:
    """Candidates that end at each row, for all lengths that fit into the window."""
    rows = rows.withColumn("L", F.explode(F.array(*(F.lit(x) for x in lengths)))).where(F.col("t") - F.col("L") + 1 >= 0)
    setup = F.concat(F.lit(f"{family}:{template}:L"), F.col("L").cast("string"), F.lit(":"), clean_token(variant))
    return rows.select("ticker", "asof_date", setup.alias("setup"), F.lit(False).alias("label"), (F.col("t") - F.col("L") + 1).alias("cand_t_start"), F.col("t").alias("cand_t_end"), F.col("L").alias("cand_length"), F.col("end_offset").alias("cand_end_offset"), *(v.alias(k) for k, v in extra.items()))


def _each(rows: DataFrame, **values: tuple) -> DataFrame:
    for name, v in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*(F.lit(x) for x in v))))
    return rows


def _short(c: str) -> Column:
    """A number as text without a trailing `.0`."""
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def gap(ind: DataFrame) -> DataFrame:
    rows = ind.where(F.col("end_offset") < LOOK).where("prev is not null and prev <> 0").withColumn("gap", F.abs(F.col("open") - F.col("prev")) / F.col("prev"))
    rows = _each(rows, g=GAPS, v=VOLUMES).where("gap >= g and vol_ratio >= v")
    variant = F.concat(F.lit("E"), F.col("end_offset").cast("string"), F.lit("_gap"), F.round(F.col("g") * 100).cast("int").cast("string"), F.lit("_vol"), F.col("v").cast("int").cast("string"), F.when(F.col("open") > F.col("prev"), "_dirup").otherwise("_dirdn"))
    return _emit(rows, "gap", "gap_event", GAP_LENGTHS, variant, {"cand_gap_pct": F.col("gap"), "cand_vol_ratio": F.col("vol_ratio"), "cand_dir_up": (F.col("open") > F.col("prev")).cast("int")})


def meanrev(ind: DataFrame) -> DataFrame:
    rows = _each(ind.where(F.col("end_offset") < LOOK), w=Z_WINDOWS).withColumn("sd", F.when(F.col("w") == 20, F.col("sd20")).otherwise(F.col("sd50")))
    rows = rows.where("t >= w and sd > 0").withColumn("z", (F.col("close") - F.col("ma20")) / F.col("sd"))
    rows = _each(rows, lim=Z_LEVELS).where("abs(z) >= lim")
    variant = F.concat(F.lit("E"), F.col("end_offset").cast("string"), F.lit("_z"), _short("lim"), F.lit("_w"), F.col("w").cast("string"))
    return _emit(rows, "meanrev", "zscore_extreme", Z_LENGTHS, variant, {"cand_z": F.col("z"), "cand_z_window": F.col("w")})


def pivot(ind: DataFrame) -> DataFrame:
    """A pullback of 1 to 4 bars from above the 20-bar mean, and a close back above the 10-bar mean and the last close."""
    lag = lambda c, k: F.lag(c, k).over(by_t())
    per = [F.struct(F.lit(k).alias("pb"), lag("close", k + 1).alias("ctx"), lag("ma20", k + 1).alias("ctx_ma"), F.min("low").over(by_t().rowsBetween(-k, -1)).alias("pull_low")) for k in PULLBACKS]
    rows = ind.withColumn("_pb", F.array(*per)).withColumn("pull_ma", lag("ma10", 1)).withColumn("pull_atr", lag("atr14", 1))
    rows = rows.where(F.col("end_offset") < LOOK).where("t >= 5").withColumn("_x", F.explode("_pb")).select("*", "_x.*").where("t - pb >= 1")
    rows = rows.where("ctx > ctx_ma and close > ma10 and close > prev")
    variant = F.concat(F.lit("E"), F.col("end_offset").cast("string"), F.lit("_pb"), F.col("pb").cast("string"))
    depth = F.when(F.col("pull_atr") > 0, (F.col("pull_ma") - F.col("prev")) / F.col("pull_atr"))
    return _emit(rows, "pivot", "shakeout_reclaim", PIVOT_LENGTHS, variant, {"cand_pullback_len": F.col("pb"), "cand_pullback_ret": ratio("prev", "ctx") - 1, "cand_pull_low": F.col("pull_low"), "cand_depth_atr": depth})


def flag(ind: DataFrame) -> DataFrame:
    """The strongest 5-bar rise in the first two thirds of a segment (the first of equal ones), of 5 % or more, then a
    quieter range (mean ATR ratio at most 1) that gives back at most 0.8 of it."""
    a = ind.groupBy("ticker", "asof_date").agg(F.array_sort(F.collect_list(F.struct("t", "close", "atr_ratio"))).alias("b"), F.max("t").alias("_top"))
    a = a.select("ticker", "asof_date", F.col("b.close").alias("c"), F.col("b.atr_ratio").alias("q"), F.explode(F.sequence(F.col("_top") - (LOOK - 1), F.col("_top"))).alias("t"), "_top")
    a = _each(a, L=FLAG_LENGTHS).withColumn("s", F.col("t") - F.col("L") + 1).where("s >= 0 and get(c, s) <> 0")
    end = F.col("s") + F.floor(F.lit(0.66) * (F.col("t") - F.col("s"))).cast("int")
    a = a.withColumn("stop", F.greatest("s", end - (IMPULSE - 1)))
    rise = F.transform(F.sequence("s", "stop"), lambda i: F.struct((F.try_divide(F.get("c", i + (IMPULSE - 1)), F.get("c", i)) - 1).alias("ret"), (-i).alias("neg")))
    a = a.withColumn("best", F.array_max(F.filter(rise, lambda x: x["ret"].isNotNull()))).where("best is not null")
    a = a.withColumn("i", -F.col("best.neg")).withColumn("j", -F.col("best.neg") + (IMPULSE - 1))
    mean = lambda x: F.aggregate(F.filter(x, lambda v: v.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: F.try_divide(acc["s"], acc["n"]))
    a = a.withColumn("atr_imp", mean(F.slice("q", F.col("i") + 1, F.lit(IMPULSE)))).withColumn("atr_con", mean(F.slice("q", F.col("j") + 2, F.greatest(F.col("t") - F.col("j"), F.lit(0)))))
    low = F.array_min(F.slice("c", F.col("j") + 1, F.col("t") - F.col("j") + 1))
    a = a.withColumn("retrace", F.try_divide(F.get("c", F.col("j")) - low, F.get("c", F.col("j")) - F.get("c", F.col("i"))))
    a = a.withColumn("total", ratio(F.get("c", F.col("t")), F.get("c", F.col("s"))) - 1)
    a = a.where("best.ret >= 0.05 and atr_con <= 1.0 and retrace <= 0.8").withColumn("end_offset", F.col("_top") - F.col("t"))
    two = lambda c: F.format_string("%.2f", F.col(c))
    variant = F.concat(F.lit("E"), F.col("end_offset").cast("string"), F.lit(f"_k{IMPULSE}_imp"), two("best.ret"), F.lit("_atrexp"), F.coalesce(two("atr_imp"), F.lit("nan")), F.lit("_atrcon"), two("atr_con"))
    setup = F.concat(F.lit("flag:impulse_consolidation:L"), F.col("L").cast("string"), F.lit(":"), clean_token(variant))
    return a.select("ticker", "asof_date", setup.alias("setup"), F.lit(False).alias("label"), F.col("s").alias("cand_t_start"), F.col("t").alias("cand_t_end"), F.col("L").alias("cand_length"), F.col("end_offset").alias("cand_end_offset"), F.col("total").alias("cand_total_ret"), F.col("best.ret").alias("cand_impulse_ret"), F.lit(IMPULSE).alias("cand_impulse_k"), F.col("atr_imp").alias("cand_impulse_atr_ratio"), F.col("atr_con").alias("cand_consolidation_atr_ratio"), F.col("retrace").alias("cand_retrace"))


def every(last: DataFrame, size: int = 100) -> DataFrame:
    """All templates, in their order; of equal (ticker, asof_date, setup) the first stays. Columns that a template lacks
    are NULL."""
    ind = written(indicators(last, size))  # each template reads it
    parts = [f(ind).withColumn("_k", F.lit(k)) for k, f in enumerate((gap, meanrev, pivot, flag))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    keys = ["ticker", "asof_date", "setup"]
    rest = [c for c in rows.columns if c not in (*keys, "_k")]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_k", "cand_end_offset")).alias("r"))
    return one.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
