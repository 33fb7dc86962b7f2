"""A stored index of embedded sliding windows that is kept up to date: only new windows are embedded."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ticker_bucket
from ..sources.shared import written
from .embed import window_embeddings
from .normalize import returns_relative, zscore
from .windows import sliding, window_rows

FOLDERS = ["window_size", "ticker_bucket", "end_year_month"]
GRID = ["ticker", "window_size", "stride"]
MANIFEST = "ticker string, window_size int, stride int, last_date date, n_windows bigint"


@dataclass(frozen=True)
class Encoder:
    """What an index's embeddings depend on; it is stored beside the index and can't change while that stays."""

    columns: tuple[str, ...] = ("open", "close", "volume")
    length: int = 32
    dims: int = 128
    seed: int = 1337

    def embed(self, bar: DataFrame, wins: DataFrame) -> DataFrame:
        """(window_id, embedding) of the given windows."""
        rows = window_rows(bar, wins).withColumnRenamed("window_id", "sample_id").withColumnRenamed("pos", "t")
        rows = zscore(returns_relative(rows).select("sample_id", "t", *self.columns), self.columns)
        return window_embeddings(rows, "sample_id", "t", self.columns, length=self.length, dims=self.dims, seed=self.seed).withColumnRenamed("sample_id", "window_id")


def _or_none(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(ticker, window_size, stride, last_date, n_windows) of an index: the newest end of a window. None if there is no index."""
    return _or_none(lambda: spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; its folders are columns, so that filters and joins on them leave the others unread."""
    return spark.read.option("inferSchema", False).parquet(f"{path}/windows").withColumn("window_size", F.col("window_size").cast("int"))


def encoder_of(spark: SparkSession, path: str) -> Encoder | None:
    rows = _or_none(lambda: spark.read.text(f"{path}/encoder", wholetext=True))
    if rows is None:
        return None
    kept = json.loads(rows.first().value)
    return Encoder(**{**kept, "columns": tuple(kept["columns"])})


def update_index(spark: SparkSession, path: str, bar: DataFrame, sizes: tuple[int, ...], strides: tuple[int, ...], encoder: Encoder | None = None) -> int:
    """Brings the index below `path` up to date with bar (whole histories) for every length and stride; gives the number of
    new windows. The first call makes it.

    A window is new if it ends behind the manifest's date of its ticker, length and stride; earlier bars are taken to be as
    they were (rows that came late among them would move all windows behind them: build a new index). Only new windows are
    embedded, and only folders that get some are written anew, with what they held; all others stay untouched. The
    manifest is written last, so a call that was cut off is repeated by the next one with the same result.
    """
    known = encoder_of(spark, path)
    encoder = encoder or known or Encoder()
    if known is None:
        spark.createDataFrame([(json.dumps(asdict(encoder)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/encoder")
    elif known != encoder:
        raise ValueError(f"the index was made by another encoder: {known}")
    every = None
    for stride in strides:
        wins = sliding(bar, sizes, stride)
        every = wins if every is None else every.unionByName(wins)
    old = manifest(spark, path)
    old = written(old) if old is not None else None  # it is written anew below
    if old is not None:
        every = every.join(old.select(*GRID, "last_date"), GRID, "left").where(F.col("last_date").isNull() | (F.col("end_date") > F.col("last_date"))).drop("last_date")
    new = written(every.withColumn("ticker_bucket", ticker_bucket("ticker")))
    n = new.count()
    if not n:
        return 0
    rows = new.join(encoder.embed(bar, new), "window_id")
    touched = new.select(*FOLDERS).distinct()  # folders, of which an update touches few
    index = _or_none(lambda: open_index(spark, path))
    if index is not None:
        kept = index.join(F.broadcast(touched), FOLDERS, "left_semi").join(new.select("window_id"), "window_id", "left_anti")
        rows = rows.unionByName(kept.select(rows.columns))
    rows = written(rows)
    rows.repartition(*FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*FOLDERS).parquet(f"{path}/windows")
    counts = new.groupBy(*GRID).agg(F.max("end_date").alias("last_date"), F.count("*").alias("n_windows"))
    if old is not None:
        counts = counts.unionByName(old).groupBy(*GRID).agg(F.max("last_date").alias("last_date"), F.sum("n_windows").alias("n_windows"))
    counts.write.mode("overwrite").parquet(f"{path}/manifest")
    return n
