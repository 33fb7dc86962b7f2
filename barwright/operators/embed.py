"""Window embeddings, their index, and similarity search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ticker_bucket
from . import cosines
from .window_features import pooled

EPS = 1e-12
QUERY_ROWS = 10_000  # queries that are sent at once


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(a: str | Column) -> Column:
    """The vector over its length (1e-12 at least), which an array of one holds: in the lambda it would be summed up anew for
    each entry."""
    n = F.greatest(F.sqrt(dot(a, a)), F.lit(EPS))
    return F.get(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m)), F.lit(0))


def rounded_cosine(c: str, places: int) -> Column:
    """Rounded as SQL engines round doubles: halves of the scaled number away from zero, without a negative zero. Arithmetic
    alone, as pairs are many; `F.round` goes by way of decimal texts."""
    x, scale = F.col(c), F.lit(10.0**places)
    t = F.abs(x) * scale
    whole = F.floor(t) + F.when(t - F.floor(t) >= 0.5, 1).otherwise(0)
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * whole / scale + F.lit(0.0))


def cosine_pairs(items: DataFrame, queries: DataFrame, key: str, vector: str, *, block: int = QUERY_ROWS) -> DataFrame:
    """(query, key, cosine) of a stated query set against all items. The queries are counted and sent to the items' tasks;
    more than `block` (or than 64 MB of them) go in blocks of about so many, one pass over the items each. The cosine is
    null where a vector is missing, holds a null or is of another length than the query's."""
    schema = f"query {dict(queries.dtypes)[key]}, `{key}` {dict(items.dtypes)[key]}, cosine double"
    rows, blocks = _by_block(items, queries, key, vector, block)
    return reduce(DataFrame.unionByName, [rows.mapInArrow(cosines.all_pairs(items.sparkSession, b), schema) for b in blocks])


def _by_block(items: DataFrame, queries: DataFrame, key: str, vector: str, block: int) -> tuple[DataFrame, list[cosines.Block]]:
    """The items, dealt to tasks, and blocks of queries; all rows of a query are in one block."""
    n, most = cosines.block_rows(queries, vector, block)
    blocks = max(1, math.ceil(n / most))
    q = cosines.numbers(queries, key, vector)
    own = [q] if blocks == 1 else [q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]
    return cosines.spread(cosines.numbers(items, key, vector), min(n, most)), [cosines.Block.of(x) for x in own]


def nearest(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, block: int = QUERY_ROWS) -> DataFrame:
    """The k nearest items of each query, itself left out, ties in order of key, missing cosines last. Exact: each task finds
    its k nearest of each query of a block, and those of all tasks are ranked."""
    items, queries = (x.where(F.col(key).isNotNull()) for x in (items, queries))
    schema = f"query {dict(queries.dtypes)[key]}, `{key}` {dict(items.dtypes)[key]}, cosine double"
    rows, blocks = _by_block(items, queries, key, vector, block)
    rows = rows.sortWithinPartitions(key)
    return reduce(DataFrame.unionByName, [ranked(rows.mapInArrow(cosines.nearest(items.sparkSession, b, k), schema), key, k) for b in blocks])


def ranked(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest of each query, with their ranks."""
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _projection(d_in: int, d_out: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d_in, d_out)) / np.sqrt(d_out)


def _curve(y: np.ndarray, n: int) -> np.ndarray:
    s = pd.Series(y).ffill().bfill().to_numpy()
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(s)), s) if len(s) and not np.isnan(s).any() else np.zeros(n)


def encode(stats: DataFrame, key: str, stat_columns: list[str], curves: str, *, length: int = 32, dims: int = 128, seed: int = 1337) -> DataFrame:
    """(key, embedding): statistics and curves (an array of one array a feature, resampled to `length`), missing values
    as 0, projected to `dims` with a fixed Gaussian matrix, of length 1. Interpolation and the matrix product run on
    Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = None
        for df in batches:
            left = df[stat_columns].to_numpy(float)
            right = np.array([np.concatenate([_curve(np.array([np.nan if v is None else v for v in y], float), length) for y in row]) for row in df[curves]])
            x = np.nan_to_num(np.hstack([left, right.reshape(len(df), -1)]), nan=0.0, posinf=0.0, neginf=0.0)
            if dims < x.shape[1]:
                matrix = _projection(x.shape[1], dims, seed) if matrix is None else matrix
                x = x @ matrix
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
            yield pd.DataFrame({key: df[key], "embedding": list(x.astype(np.float32))})

    kind = dict(stats.dtypes)[key]
    return stats.select(key, *stat_columns, curves).mapInPandas(run, f"{key} {kind}, embedding array<float>")


STATISTICS = ("mean", "std", "min", "max", "last", "slope")


def window_embeddings(rows: DataFrame, key: str, t: str, columns: tuple[str, ...], *, length: int = 32, dims: int = 128, seed: int = 1337) -> DataFrame:
    """(key, embedding) of windows in long form: pooled statistics and curves of the columns, encoded."""
    curves = F.array(*(F.transform(F.array_sort(F.collect_list(F.struct(t, F.col(c).cast("double").alias("v")))), lambda x: x["v"]) for c in columns))
    stats = pooled(rows, columns, key, t).join(rows.groupBy(key).agg(curves.alias("curves")), key)
    return encode(stats, key, [f"{c}_{s}" for c in columns for s in STATISTICS], "curves", length=length, dims=dims, seed=seed)


def write_index(index: DataFrame, path: str) -> None:
    """Folders window_size / ticker_bucket / end_year_month; one file in each, since rows are dealt by folder first."""
    folders = ["window_size", "ticker_bucket", "end_year_month"]
    index.withColumn("ticker_bucket", ticker_bucket("ticker")).repartition(*folders).write.mode("overwrite").option("compression", "zstd").partitionBy(*folders).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index; its folders are columns, so that filters and joins on them leave the others unread."""
    return spark.read.option("inferSchema", False).parquet(path).withColumn("window_size", F.col("window_size").cast("int"))


def lookup(index: DataFrame, examples: DataFrame) -> DataFrame:
    """Index rows of example windows(ticker, end_date, window_size, stride, start_idx). The join keys include the folders,
    derived from the examples, so that Spark prunes those that no example names."""
    keys = ["ticker", "end_date", "window_size", "stride", "start_idx"]
    asked = examples.select(*keys).withColumn("ticker_bucket", ticker_bucket("ticker")).withColumn("end_year_month", F.date_format("end_date", "yyyy-MM"))
    folders = [c for c in ("ticker_bucket", "end_year_month") if c in index.columns]
    return index.join(asked.select(*keys, *folders), [*keys, *folders])
