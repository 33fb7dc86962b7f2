"""Incremental upsert of bars with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import merged


def upsert(spark: SparkSession, batch: DataFrame, table_path: str) -> None:
    """Merges a batch of bars(ticker, date, ..., asof_ts) into the folders by date that it touches; the latest asof_ts of
    each (ticker, date) stays, so a batch that runs twice changes nothing."""
    batch = batch.persist()
    try:
        dates = [r.date for r in batch.select("date").distinct().collect()]  # the folders to rewrite
        if not dates:
            return
        try:
            old = spark.read.schema(batch.schema).parquet(table_path).where(F.col("date").isin(dates))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        newest = merged(old.select(batch.columns), batch.select(batch.columns)).select(batch.columns)
        newest.checkpoint().repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(table_path)
    finally:
        batch.unpersist()


def bars_upsert_stream(spark: SparkSession, source: str, schema, table_path: str, checkpoint: str) -> StreamingQuery:
    """Reads bar files as they arrive in `source` and upserts each micro-batch; late bars rewrite their date's folder."""
    if not spark.sparkContext.getCheckpointDir():  # the folders that are rewritten are also read
        spark.sparkContext.setCheckpointDir(f"{checkpoint}-rows")
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: upsert(df.sparkSession, df, table_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
