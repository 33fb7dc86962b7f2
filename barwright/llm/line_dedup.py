"""Line dedup (operator 13): levelled sorted runs of line hashes.

Lines are counted by a 128-bit hash of their key. Counts are kept in runs: tables of (key, n) in sorted buckets of the
key. Each new batch of documents is merged against the runs, keys that a run already holds often enough are dropped from it
(an anti-join), and what is left becomes a run of level 0. Two runs of one level are merged into one of the next, so that
there are never more runs than the logarithm of the batches. All runs have the same buckets, so merges and anti-joins
read bucket by bucket and shuffle nothing; only the counts of a new batch are dealt out.
"""

from __future__ import annotations

import contextlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

LEAST = 10  # documents that make a line common
BATCHES = 8
HELD = 1 << 18  # keys that a task counts before it gives them out
BROADCAST_KEYS = 1 << 18  # common keys (16 bytes each) that every task holds at most
BUCKET_ROWS, MOST_BUCKETS = 1 << 21, 1 << 14


def line_key(line: bytes) -> bytes:
    """A line without blanks `[\\x20\\x09-\\x0D]` at its ends and with A-Z in lower case."""
    return line.strip().lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    return (v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(batch.schema.get_field_index(name)))


def line_counts(docs: DataFrame, text_col: str = "text", *, least_chars: int = 1) -> DataFrame:
    """(key, n): hashes of the keys of at least least_chars code points, and the number of documents that have each,
    as counted within pieces of a task; a key comes once for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["key", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in _texts(batch, "t"):
                keys = {line_key(x) for x in text.split(b"\n")}
                held.update(key_hash(k) for k in keys if len(k) >= least_chars and (least_chars < 2 or len(k.decode()) >= least_chars))
                if len(held) >= HELD:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "key binary, n long")


class LineRuns:
    """The runs: `levels[i]` are names of tables of level i, one at most between two calls of add(). Their files are in
    the shared folder; close() drops the tables' names."""

    def __init__(self, spark: SparkSession, buckets: int, least: int = LEAST):
        self.spark, self.buckets, self.least, self.folder = spark, buckets, least, shared_dir(spark)
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _stored(self, rows: DataFrame) -> str:
        name = f"barwright_run_{uuid.uuid4().hex}"
        self.made.append(name)
        rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """A batch of (key, n), a key in several rows or in one. What the runs know to be common is left out."""
        new = counts.repartition(self.buckets, "key").groupBy("key").agg(F.sum("n").alias("n"))
        for run in self.runs():
            new = new.join(run.where(F.col("n") >= self.least).select("key").hint("merge"), "key", "left_anti")
        self._push(0, self._stored(new))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            first, second = self.levels[level]
            self.levels[level] = []
            self._push(level + 1, self._merged(first, second))

    def _merged(self, first: str, second: str) -> str:
        """Both runs as one: a merge join of their sorted buckets."""
        a, b = self.spark.table(first).alias("a"), self.spark.table(second).alias("b").hint("merge")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return self._stored(a.join(b, "key", "full").select("key", n.alias("n")))

    def common(self) -> DataFrame:
        """Keys (key) that at least `least` documents have: all runs are merged into one, the youngest first. (A union of
        them isn't grouped: Spark 4.1 takes a union of bucketed tables for dealt by key, which it isn't.)"""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "key binary")
        self.levels = [[] for _ in self.levels]
        self.levels[-1] = [reduce(self._merged, names)]
        return self.spark.table(self.levels[-1][0]).where(F.col("n") >= self.least).select("key")

    def close(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made, self.levels = [], []


def common_lines(docs: DataFrame, text_col: str = "text", *, least: int = LEAST, least_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """Hashes (key) of the keys that at least `least` rows of docs have. Texts are read once; their counts are dealt by task
    to `batches` batches, which go through the runs one after the other."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark) + "/counts"
    line_counts(docs, text_col, least_chars=least_chars).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches))).write.partitionBy("batch").parquet(folder)
    counts = spark.read.schema("key binary, n long, batch int").parquet(folder)
    total = {r.batch: r.n for r in counts.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    with contextlib.closing(LineRuns(spark, min(MOST_BUCKETS, max(8, -(-sum(total.values()) // BUCKET_ROWS))), least)) as runs:
        for k in sorted(total):
            runs.add(counts.where(F.col("batch") == k).select("key", "n"))
        return written(runs.common())


def drop_common_lines(docs: DataFrame, common: DataFrame, text_col: str = "text", *, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with n_lines, n_dropped and kept: the text without the lines whose key's hash is in common(key).

    Up to `broadcast_keys` keys, by their count, go to every task. More of them are joined with the lines of the texts (each
    text once a task), and the numbers of the lines to drop come back by a hash of the text.
    """
    taken = {c.lower() for c in docs.columns} & {"n_lines", "n_dropped", "kept"}
    if taken:
        raise ValueError(f"columns have names of results: {sorted(taken)}")
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rest, added = docs.columns, ", n_lines long, n_dropped long, kept string"
    marks = None
    if common.count() <= broadcast_keys:
        marks = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.key) for r in common.collect()))
        rows, numbers = docs, None
    else:
        key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))

        def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[str] = set()
            for batch in batches:
                of, keys, numbers = [], [], []
                for name, text in zip(batch.column(0).to_pylist(), _texts(batch, "t"), strict=True):
                    if name in seen:
                        continue
                    seen.add(name)
                    for i, x in enumerate(text.split(b"\n")):
                        if k := line_key(x):
                            of.append(name)
                            keys.append(key_hash(k))
                            numbers.append(i)
                if len(seen) > HELD:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int32())], ["of", "key", "i"])

        lines = docs.select(key.alias("of"), F.col(text_col).cast("binary").alias("t")).mapInArrow(lines_of, "of string, key binary, i int")
        dropped = lines.join(common, "key", "left_semi").groupBy("of").agg(F.collect_set("i").alias("drop"))
        rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("of")).join(dropped, "of", "left").select("row.*", F.col("drop").alias("__drop"))
        numbers = "__drop"
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(batch.num_columns - 1).to_pylist() if numbers else [None] * batch.num_rows
            n, gone, kept = [], [], []
            for value, drop in zip(batch.column(at), drops, strict=True):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                lines = text.split(b"\n")
                if numbers:
                    out = set(drop or ())
                    stay = [x for i, x in enumerate(lines) if i not in out]
                else:
                    stay = [x for x in lines if not (k := line_key(x)) or key_hash(k) not in marks.value]
                n.append(len(lines))
                gone.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            own = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*rest, "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(run, schema + added)


def dedup_lines(docs: DataFrame, text_col: str = "text", *, least: int = LEAST, least_chars: int = 1, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept: lines whose key at least `least` rows of docs have are dropped
    everywhere, the others stay as they are, joined by \\n.

    A null or empty text is one empty line. Keys of fewer than least_chars code points (an empty one always) are never
    dropped. Each row is a document, whatever its id; a line counts once in it. If every line goes, what is kept is empty.
    Other columns stay; ones named n_lines, n_dropped or kept are an error. No rows give no rows.
    """
    return drop_common_lines(docs, common_lines(docs, text_col, least=least, least_chars=least_chars, batches=batches), text_col, broadcast_keys=broadcast_keys)
