"""Tables of run artifacts, and sinks by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_json(rows: DataFrame, value: str = "value", depth: int = 3) -> DataFrame:
    """rows with (key, val) of each JSON object in `value`: nested keys are dotted down to `depth`, lists and deeper
    objects stay JSON text. Texts that aren't objects give no rows."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    rest = [c for c in rows.columns if c != value]
    level = rows.select(*rest, F.explode(as_map(value)).alias("key", "val"))
    done = None
    for k in range(1, depth + 1):
        nested = F.col("val").startswith("{") & F.lit(k < depth)
        flat = level.where(~F.coalesce(nested, F.lit(False)))
        done = flat if done is None else done.unionByName(flat)
        if k < depth:
            level = level.where(nested).select(*rest, F.col("key").alias("_k"), F.explode(as_map("val")).alias("key", "val")).withColumn("key", F.concat_ws(".", "_k", "key")).drop("_k")
    return done


def run_index(files: DataFrame) -> DataFrame:
    """files(path, value): one row for each run folder `.../<model>/<setup>/<run>/<file>.json` with a map of the flattened
    keys of all its files, prefixed with the file's name."""
    part = F.split("path", "/")
    n = F.size(part)
    named = files.select(F.get(part, n - 4).alias("model"), F.get(part, n - 3).alias("setup"), F.get(part, n - 2).alias("run"), F.regexp_replace(F.get(part, n - 1), r"\.json$", "").alias("file"), "value")
    flat = flatten_json(named)
    return flat.groupBy("model", "setup", "run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "file", "key").alias("k"), F.col("val").alias("v"))))).alias("entries"))


def read_runs(spark, path: str, files: str = "*.json") -> DataFrame:
    """run_index of all files below `path` whose names match; folders of the form key=value count as value."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=files)
    name = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/=]+=", "/")
    return run_index(rows.select(name.alias("path"), "value"))


def digests(spark, path: str, files: str = "*") -> DataFrame:
    """(path, length, digest): SHA-256 of the bytes of each file below `path` whose name matches."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("digest"))


def write_table(df: DataFrame, path: str) -> None:
    """Writes df in the format of the path's suffix: .parquet (zstd), .csv or .jsonl."""
    w = df.write.mode("overwrite")
    if path.endswith(".parquet"):
        w.option("compression", "zstd").parquet(path)
    elif path.endswith(".csv"):
        w.option("header", True).csv(path)
    elif path.endswith(".jsonl"):
        w.json(path)
    else:
        raise ValueError(f"unknown suffix: {path}")
