"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where it is unset: a temporary folder of a
    local session, whose executors are the driver itself; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_barwright_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark._barwright_shared = base
    return f"{base.rstrip('/')}/barwright-{uuid.uuid4().hex}"


def written(df: DataFrame, *, partitions: int | None = None, codec: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors. codec: of the files,
    where it isn't to be the session's."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession) + "/table"
    (df.coalesce(partitions) if partitions else df).write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
