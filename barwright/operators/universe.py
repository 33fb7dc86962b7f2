"""Listings: loading, normalising, filtering, and one row for each ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_key, exchange_of  # noqa: F401  (also taken from here)

def load(rows: DataFrame) -> DataFrame:
    """rows(ticker, ..., seq): tickers trimmed and upper-cased, blank ones dropped, the first of each by seq kept. `NA` is
    a ticker like any other."""
    r = rows.withColumn("ticker", clean_key("ticker")).where("ticker is not null and ticker <> ''")
    return _first(r, ["ticker"], "seq")


def _first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def prefer_source(rows: DataFrame) -> DataFrame:
    """Of each ticker the row of the lowest source_rank."""
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy("source_rank", "name"))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def filtered(universe: DataFrame, exchanges: tuple[str, ...], *, etf: bool = False, test: bool = False) -> DataFrame:
    df = universe.where(F.col("exchange").isin(*exchanges))
    if not etf:
        df = df.where("not is_etf")
    return df if test else df.where("not is_test_issue")
