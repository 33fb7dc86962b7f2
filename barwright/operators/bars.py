"""Bar tables: features, the last N bars, upserts, ingest plans, and ranked scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

FEATURES = ("ret_1d", "ret_5d", "ret_21d", "vol_avg_20", "dollar_vol_avg_20", "range_pct")


def features(bar: DataFrame) -> DataFrame:
    """bar with returns over 1, 5 and 21 rows, 20-row averages of volume and dollar volume, and the day's range.
    One exchange by ticker; all windows share its order."""
    line = Window.partitionBy("ticker").orderBy("date")
    last20 = line.rowsBetween(-19, 0)
    back = {k: ratio("close", F.lag("close", k).over(line)) - 1 for k in (1, 5, 21)}
    return bar.select("*", *(v.alias(f"ret_{k}d") for k, v in back.items()), F.avg("volume").over(last20).alias("vol_avg_20"), F.avg(F.col("close") * F.col("volume")).over(last20).alias("dollar_vol_avg_20"), ratio(F.col("high") - F.col("low"), "close").alias("range_pct"))


def last_n(feats: DataFrame, n: int = 100) -> DataFrame:
    """The newest n rows of each ticker, rn 1 being the newest; features are of the whole history."""
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return feats.withColumn("rn", rn.cast("bigint")).where(F.col("rn") <= n)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old and new(ticker, date, ..., asof_ts): of each (ticker, date) a new one, then the latest asof_ts, stays."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("ticker", "date", "is_new")]
    best = F.max_by(F.struct(*rest), F.struct("is_new", "asof_ts", "close"))
    return both.groupBy("ticker", "date").agg(best.alias("r")).select("ticker", "date", "r.*")


def merge_status(universe: DataFrame, old: DataFrame, merged_bars: DataFrame, new: DataFrame) -> DataFrame:
    """(ticker, status, rows_written, last_date): updated, no_change (no new rows) or no_data, for every ticker."""
    after = merged_bars.groupBy("ticker").agg(F.count("*").alias("rows_written"), F.max("date").alias("last_date"))
    fresh = new.groupBy("ticker").agg(F.count("*").alias("n_new"))
    rows = universe.select("ticker").distinct().join(after, "ticker", "left").join(fresh, "ticker", "left")
    status = F.when(F.col("rows_written").isNull(), "no_data").when(F.col("n_new").isNull(), "no_change").otherwise("updated")
    return rows.select("ticker", status.alias("status"), F.coalesce("rows_written", F.lit(0)).alias("rows_written"), "last_date")


def incremental_plan(tickers: DataFrame, bar: DataFrame, start, end: DataFrame | None = None) -> DataFrame:
    """(ticker, start, end) still to fetch: the day after each ticker's last bar, `start` without bars; done ones go. end: one
    row (end), the newest date with bars by default."""
    last = bar.groupBy("ticker").agg(F.max("date").alias("last_date"))
    end = bar.agg(F.max("date").alias("end")) if end is None else end
    first = F.coalesce(F.date_add("last_date", 1), F.lit(start).cast("date"))
    return tickers.join(last, "ticker", "left").crossJoin(F.broadcast(end)).select("ticker", first.alias("start"), "end").where("start <= end")


def top(last: DataFrame, by, n: int, where=None) -> DataFrame:
    """The n highest rows by `by` among each ticker's newest bar; equal values in order of ticker."""
    rows = last.where("rn = 1").where(by.isNotNull())
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(by.desc(), "ticker").limit(n)
