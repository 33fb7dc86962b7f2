"""A stored vector index for nearest neighbours: folders of k-means cells, of which a query reads a few."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cosines
from .embed import ranked, unit

SAMPLE = 50_000  # rows that cells are fitted on at most
MOST_CELLS = 4_096
BLOCK = 10_000  # queries that are probed at once


@dataclass(frozen=True)
class VectorIndex:
    """A folder of rows by cell, and the cells' centres."""

    path: str
    key: str
    vector: str
    centres: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """(key, vector of length 1, cell) of the whole index."""
        return spark.read.parquet(f"{self.path}/rows")


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector of length 1) of rows with a vector of finite entries."""
    v = df.select(key, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    v = v.where(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))))
    return v.select(key, unit(vector).alias(vector))


def _ranked(centres: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector by cosine, the nearest first."""
    near = vectors @ centres.T
    if n == 1:
        return np.argmax(near, axis=1)[:, None]
    if n >= near.shape[1]:
        return np.argsort(-near, axis=1, kind="stable")
    some = np.argpartition(-near, n, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def _with_cells(df: DataFrame, vector: str, centres: np.ndarray, n: int) -> DataFrame:
    """df with `cells`: an array of the n nearest cells. Centres (at most MOST_CELLS) are sent to every task."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    at = df.columns.index(vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = _ranked(sent.value, x, n).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cells"])

    return df.mapInArrow(run, schema + ", cells array<int>")


def build_index(df: DataFrame, path: str, key: str, vector: str, *, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """Writes an index of df's rows below `path` and returns it. Rows without a vector, or with entries that aren't
    finite, can't be found and go.

    Cells (about the root of the number of rows, MOST_CELLS at most) are fitted by Spark's k-means on up to `sample` rows,
    drawn by a hash of the key; every row goes to its nearest cell, in a folder of the cell. Of a large table a cell is
    dealt to several files.
    """
    rows = _usable(df, key, vector)
    n = rows.count()
    cells = max(1, min(MOST_CELLS, cells or round(math.sqrt(n)), n or 1))
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    if n:
        drawn = drawn.repartition(df.sparkSession.sparkContext.defaultParallelism)  # a few files would be as few tasks
        fitted = KMeans(k=cells, seed=seed, maxIter=15, initSteps=2, featuresCol="f").fit(drawn.select(array_to_vector(vector).alias("f")))
        centres = np.array(fitted.clusterCenters())
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    else:
        centres = np.zeros((1, 1))
    placed = _with_cells(rows, vector, centres, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    part = F.pmod(F.xxhash64(key), F.lit(max(1, n // (len(centres) * 500_000))))
    placed.repartition("cell", part).sortWithinPartitions("cell").write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(key, vector)], "key string, vector string").coalesce(1).write.json(f"{path}/names")
    return VectorIndex(path, key, vector, centres)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before, in this session or another."""
    names = spark.read.schema("key string, vector string").json(f"{path}/names").first()
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return VectorIndex(path, names.key, names.vector, np.array([r.centre for r in rows]))


def search(index: VectorIndex, queries: DataFrame, k: int, *, probes: int, block: int = BLOCK) -> DataFrame:
    """(query, key, cosine, rank): of each query row its k nearest among the rows of the `probes` cells next to it, itself left
    out, ties in order of key. Cosines are exact; what lies in other cells isn't found. With probes of all cells it is an
    exact search.

    Queries are worked off in blocks of `block` (or of 64 MB). A block's queries go to every task once, with a bit for each
    cell that they ask for; they meet only the folders of these cells, which the scan prunes by name. Each task finds its k
    nearest of each query, and those of all tasks are ranked.
    """
    key, vector = index.key, index.vector
    spark = queries.sparkSession
    probes = min(probes, len(index.centres))
    asked = _usable(queries, key, vector).where(F.col(key).isNotNull())
    count, most = cosines.block_rows(asked, vector, block)
    n = max(1, -(-count // most))
    best = None
    for i in range(n):
        own = cosines.Block.of(asked if n == 1 else asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == i))
        own = replace(own, asked=_asked(index.centres, own, probes))
        rows = index.rows(spark).where(F.col("cell").isin(np.flatnonzero(own.asked.any(axis=1)).tolist()))
        found = ranked(_nearest(rows, queries, own, index, k, cells=True), key, k).drop("cell")
        best = found if best is None else best.unionByName(found)
    return best


def _nearest(rows: DataFrame, queries: DataFrame, block: cosines.Block, index: VectorIndex, k: int, *, cells: bool) -> DataFrame:
    """(query, key, cell, cosine): of each task's index rows the k nearest of each query."""
    key = index.key
    schema = f"query {dict(queries.dtypes)[key]}, `{key}` {dict(rows.dtypes)[key]}, cell int, cosine double"
    rows = rows.where(F.col(key).isNotNull()).select(key, index.vector, "cell").sortWithinPartitions(key)
    return rows.mapInArrow(cosines.nearest(rows.sparkSession, block, k, unit=True, cells=cells), schema)


def _asked(centres: np.ndarray, block: cosines.Block, probes: int) -> np.ndarray:
    """Bits by cell and query: the cells next to each query."""
    x = block.vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(block.keys), centres.shape[1])
    asked = np.zeros((len(centres), len(x)), bool)
    for lo in range(0, len(x), 1_000):
        near = _ranked(centres, x[lo : lo + 1_000], probes)
        asked[near, lo + np.arange(len(near))[:, None]] = True
    return np.packbits(asked, axis=1)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """Share of the exact (query, key) pairs that were found."""
    pairs = exact.select("query", key).distinct().join(found.select("query", key, F.lit(1).alias("_found")).distinct(), ["query", key], "left")
    r = pairs.agg(F.count("*").alias("n"), F.count("_found").alias("found")).first()
    return r.found / r.n if r.n else 1.0


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95) -> int:
    """The fewest probes with which at least `target` of the k nearest rows of the given queries (a bounded sample, at most
    BLOCK rows) lie in probed cells: one exact search, in which each neighbour's cell gets its place among the query's."""
    key, vector = index.key, index.vector
    spark = queries.sparkSession
    cells = len(index.centres)
    asked = spark.createDataFrame(_usable(queries, key, vector).where(F.col(key).isNotNull()).limit(BLOCK).toArrow())
    top = ranked(_nearest(index.rows(spark), queries, cosines.Block.of(asked), index, k, cells=False), key, k)
    places = _with_cells(asked, vector, index.centres, cells).select(F.col(key).alias("query"), "cells")
    top = top.join(places, "query").select(F.array_position("cells", F.col("cell")).alias("place"))
    counts = {r.place: r.n for r in top.groupBy("place").agg(F.count("*").alias("n")).collect()}
    total, seen = sum(counts.values()), 0
    for p in range(1, cells + 1):
        seen += counts.get(p, 0)
        if seen >= target * total:
            return p
    return cells
