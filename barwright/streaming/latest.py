"""Each ticker's last bars and their features, kept up by a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import last_n
from ..sources.shared import written

BAR = "date date, open double, high double, low double, close double, volume bigint, asof_ts timestamp"
FEATURES = "ret_1d double, ret_5d double, ret_21d double, vol_avg_20 double, dollar_vol_avg_20 double, range_pct double"
COLUMNS = ["date", "open", "high", "low", "close", "volume", "asof_ts"]
BACK = 21  # rows that a feature looks back


def feature_rows(bars: pd.DataFrame) -> pd.DataFrame:
    """bars of one ticker in order of date, with the features of operators.bars.features."""
    close, volume = bars["close"].to_numpy(float), bars["volume"].to_numpy(float)

    def back(k: int) -> np.ndarray:
        old = np.concatenate([np.full(min(k, len(close)), np.nan), close[: max(0, len(close) - k)]])
        return np.where(old != 0, close / np.where(old == 0, np.nan, old) - 1, np.nan)

    def mean(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for i in range(len(x)):
            own = x[max(0, i - 19) : i + 1]
            own = own[~np.isnan(own)]
            out[i] = own.sum() / len(own) if len(own) else np.nan
        return out

    span = bars["high"].to_numpy(float) - bars["low"].to_numpy(float)
    new = {"ret_1d": back(1), "ret_5d": back(5), "ret_21d": back(21), "vol_avg_20": mean(volume), "dollar_vol_avg_20": mean(close * volume), "range_pct": span / np.where(close == 0, np.nan, close)}
    return bars.assign(**new)


def newest(bars: pd.DataFrame, keep: int) -> pd.DataFrame:
    """One row for each date, the one of the latest asof_ts (then the highest close), and of these the last `keep`."""
    ordered = bars.sort_values(["date", "asof_ts", "close"], kind="stable", na_position="first")
    return ordered.drop_duplicates("date", keep="last").tail(keep).reset_index(drop=True)


def _value(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def _plain(bars: pd.DataFrame) -> list[tuple]:
    """Rows as the state stores them."""
    out = []
    for r in bars[COLUMNS].itertuples(index=False, name=None):
        date, *prices, volume, ts = map(_value, r)
        out.append((date, *(None if p is None else float(p) for p in prices), None if volume is None else int(volume), None if ts is None else pd.Timestamp(ts).to_pydatetime()))
    return out


class LatestBars(StatefulProcessor):
    """State of a ticker: its last n + BACK bars. What comes is merged into them, whatever its order; rows among the last n
    whose bar or features a drop changes come out: those from the first changed date to BACK rows behind the last one."""

    def __init__(self, n: int, ttl_ms: int | None = None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", BAR, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(list(self.bars.get()), columns=COLUMNS) if self.bars.exists() else pd.DataFrame(columns=COLUMNS)
        before = {r[0]: r for r in _plain(old)}
        for part in rows:
            part = part[COLUMNS]
            old = newest(part if not len(old) else pd.concat([old, part]), self.n + BACK)
        kept = _plain(old)
        self.bars.put(kept)
        changed = [i for i, r in enumerate(kept) if before.get(r[0]) != r]
        if not changed:
            return
        out = feature_rows(old)
        near = np.zeros(len(out), bool)
        for i in changed:
            near[i : i + BACK + 1] = True
        near[: max(0, len(out) - self.n)] = False
        out = out[near]
        if len(out):
            out.insert(0, "ticker", key[0])
            yield out

    def close(self) -> None:
        pass


SCHEMA = f"ticker string, {BAR}, {FEATURES}, bucket int"
BUCKETS = 16  # folders of the table; a micro-batch rewrites those of its tickers


def put(spark: SparkSession, batch: DataFrame, path: str, n: int) -> None:
    """Puts rows of (ticker, date) in the place of the table's or beside them, and leaves the last n of each ticker. A batch
    that runs twice changes nothing."""
    batch = batch.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
        if not touched:
            return
        try:
            old = spark.read.schema(SCHEMA).parquet(path).where(F.col("bucket").isin(touched))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        both = old.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        rest = [c for c in batch.columns if c not in ("ticker", "date")]
        rows = both.groupBy("ticker", "date").agg(F.max_by(F.struct(*rest), "_new").alias("_r")).select("ticker", "date", "_r.*")
        rows = written(last_n(rows, n).drop("rn"))  # the folders that are rewritten were read
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        batch.unpersist()


def last_bars_stream(spark: SparkSession, source: str, table_path: str, checkpoint: str, *, n: int = 100, ttl_ms: int | None = None) -> StreamingQuery:
    """Reads bar files (ticker, BAR) as they arrive in `source` and keeps the table at the last n bars of each ticker with
    their features.

    Of bars of one ticker and date the latest asof_ts counts, so any order and any split of the same files give the
    same rows. ttl_ms: a ticker that had no bar for so long is forgotten; it starts anew when one comes. Bars without a
    ticker or a date go. State is kept in RocksDB, whose provider is set while the query starts.
    """
    stream = spark.readStream.schema(f"ticker string, {BAR}").parquet(source).where("ticker is not null and date is not null")
    kept = stream.groupBy("ticker").transformWithStateInPandas(LatestBars(n, ttl_ms), f"ticker string, {BAR}, {FEATURES}", "Update", "ProcessingTime" if ttl_ms else "None")
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return kept.writeStream.outputMode("update").foreachBatch(lambda df, _: put(df.sparkSession, df, table_path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, was)


def read_last(spark: SparkSession, table_path: str, n: int = 100) -> DataFrame:
    """The last n bars of each ticker in the stream's table, rn 1 being the newest."""
    return last_n(spark.read.schema(SCHEMA).parquet(table_path).drop("bucket"), n)
