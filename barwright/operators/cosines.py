"""Cosines of a block of queries with Arrow batches of items: all of them, or the k nearest items of each query.

A cosine is summed in order of place, as `embed.dot` does, so that equal vectors have equal cosines wherever they lie. For the nearest,
matrix products in single precision tell what can't be near, within a bound on their error; the others are summed in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-12
NULL, NAN = -3.0, 3.0  # in place of a cosine that is null (the last in order) or isn't a number (the first)
PAIRS = 1 << 16  # rows of an Arrow batch of pairs
TILE = 1 << 21  # cosines that are looked at together
WIDE = 1 << 12  # items in a tile at most
HELD = 16 << 20  # bytes of items' vectors that are held together, as doubles
SENT = 64 << 20  # bytes of a block's vectors, as doubles
TASK_ROWS = 100_000  # items of a task at most
TASK_PAIRS = 1_000_000  # pairs of a task at least


@dataclass(frozen=True)
class Block:
    """Queries that are sent to every task, and the cells of an index that each one asks for (bits by cell and query)."""

    keys: pa.Array
    vectors: pa.Array
    asked: np.ndarray | None = None

    @staticmethod
    def of(queries: DataFrame) -> Block:
        """A counted, bounded set of queries(key, vector)."""
        keys, vectors = (c.combine_chunks() for c in queries.toArrow().columns)
        return Block(keys, vectors)


@dataclass(frozen=True)
class Group:
    """Rows of one length, all finite or none, with their vectors in columns; length -1: no vector, or a null in it."""

    length: int
    finite: bool
    rows: np.ndarray
    matrix: np.ndarray

    def constant(self, other: Group) -> float | None:
        """The cosine of all pairs with another group's rows, if they have the same."""
        if self.length != other.length or self.length < 0:
            return NULL
        return None if self.finite and other.finite else NAN


def numbers(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(key, vector, ...) with entries as floats, or else as doubles."""
    v = F.col(vector)
    return df.select(key, v if df.schema[vector].dataType.simpleString() == "array<float>" else v.cast("array<double>").alias(vector), *more)


def block_rows(df: DataFrame, vector: str, most: int) -> tuple[int, int]:
    """Number of queries, and how many go in a block: `most`, or as many as fit SENT bytes."""
    r = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    return r.n, max(1, min(most, SENT // (8 * max(1, r.d or 1))))


def spread(items: DataFrame, queries: int) -> DataFrame:
    """Items dealt to as many tasks as their pairs are worth, however few files they come from."""
    n = items.count()
    wanted = max(2 * items.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return items.repartition(max(1, min(wanted, -(-n * queries // TASK_PAIRS))))


def _lengthwise(column: pa.Array, unit: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors in columns) of each length; vectors are divided by their norms (EPS at least) unless they are
    units. Length -1: rows without a vector or with a null in it."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, sizes = column.flatten(), np.maximum(lengths, 0)
    starts = np.cumsum(sizes) - sizes
    if flat.null_count:
        lengths[np.repeat(np.arange(len(lengths)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        m = x[starts[rows] + np.arange(max(d, 0))[:, None]]
        if not unit:
            with np.errstate(all="ignore"):
                squares = np.zeros(len(rows))
                for line in m:
                    squares += line * line
                m /= np.maximum(np.sqrt(squares), EPS)
        yield int(d), rows, m


def _groups(column: pa.Array, unit: bool) -> list[Group]:
    out = []
    for d, rows, m in _lengthwise(column, unit):
        finite = np.isfinite(m).all(axis=0)
        out += [Group(d, f, rows[own], np.ascontiguousarray(m[:, own])) for f, own in ((True, finite), (False, ~finite)) if own.any()]
    return out


def all_pairs(spark: SparkSession, block: Block) -> Callable:
    """For mapInArrow over (key, vector): (query, key, cosine) of every item with every query of the block."""
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(_lengthwise(sent.value.vectors, False))
        for batch in batches:
            for d, rows, x in _lengthwise(batch.column(1), False):
                for e, asked, q in own:
                    for lo in range(0, len(rows), WIDE):
                        at = rows[lo : lo + WIDE]
                        step = max(1, PAIRS // len(at))
                        for k in range(0, len(asked), step):
                            who = asked[k : k + step]
                            shape = len(who), len(at)
                            if d == e >= 0:
                                cosines, product = np.zeros(shape), np.empty(shape)
                                with np.errstate(all="ignore"):
                                    for a, b in zip(q[:, k : k + step], x[:, lo : lo + WIDE], strict=True):
                                        cosines += np.multiply(a[:, None], b, out=product)
                                cosines = pa.array(cosines.ravel())
                            else:
                                cosines = pa.nulls(shape[0] * shape[1], pa.float64())
                            query = sent.value.keys.take(pa.array(np.repeat(who, len(at))))
                            yield pa.RecordBatch.from_arrays([query, batch.column(0).take(pa.array(np.tile(at, len(who)))), cosines], ["query", batch.schema.names[0], "cosine"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to HELD bytes of vectors."""
    held, size = [], 0
    for batch in batches:
        more = 8 * len(batch.column(1).flatten())
        if held and size + more > HELD:
            yield pa.concat_batches(held)
            held, size = [], 0
        if batch.num_rows:
            held, size = [*held, batch], size + more
    if held:
        yield pa.concat_batches(held)


def _without_copies(alike: np.ndarray, run: np.ndarray, k: int) -> np.ndarray:
    """Places of rows, which are in order of key: of those that are alike the first k + 1 keys, k rows of each at most. A
    query that may not find its own key finds its k nearest among them."""
    order = np.argsort(alike, kind="stable")
    new = np.diff(alike[order], prepend=-1) != 0
    new_key = new | (np.diff(run[order], prepend=-1) != 0)
    n, keys = np.arange(len(order)), np.cumsum(new_key)
    nth_key = keys - np.maximum.accumulate(np.where(new, keys, 0))
    nth_row = n - np.maximum.accumulate(np.where(new_key, n, 0))
    return np.sort(order[(nth_key <= k) & (nth_row < k)])


def _alike(matrix: np.ndarray) -> np.ndarray:
    """The same number for equal vectors."""
    if not len(matrix):
        return np.zeros(matrix.shape[1], np.int64)
    rows = np.ascontiguousarray(matrix.T)
    return np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1].reshape(-1)


class _Best:
    """Of each query the k nearest items so far, by falling cosine and rising place."""

    def __init__(self, queries: int, k: int):
        self.cosine = np.full((queries, k), -np.inf)
        self.at = np.full((queries, k), -1, np.int64)

    def add(self, query: np.ndarray, cosine: np.ndarray, at: np.ndarray) -> None:
        if not len(query):
            return
        k = self.at.shape[1]
        who = np.unique(query)
        query = np.concatenate([np.repeat(who, k), query])
        cosine = np.concatenate([self.cosine[who].ravel(), cosine])
        at = np.concatenate([self.at[who].ravel(), at])
        order = np.lexsort((at, -cosine, query))
        n, q = np.arange(len(order)), query[order]
        nth = n - np.maximum.accumulate(np.where(np.diff(q, prepend=-1) != 0, n, 0))
        order, nth = order[nth < k], nth[nth < k]
        self.cosine[query[order], nth], self.at[query[order], nth] = cosine[order], at[order]


def nearest(spark: SparkSession, block: Block, k: int, *, unit: bool = False, cells: bool = False) -> Callable:
    """For mapInArrow over (key, vector, ...) in order of key: (query, key, ..., cosine) of the k items of the task that are
    nearest to each query of the block, its own key left out, ties in order of key. unit: vectors are units. cells: the last
    column is a cell, and a query meets the cells that it asks for."""
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        n = len(block.keys)
        own = [(g, np.ascontiguousarray(g.matrix.T, dtype=np.float32)) for g in _groups(block.vectors, unit)]
        values = pc.unique(block.keys)
        codes = pc.index_in(block.keys, value_set=values).to_numpy(zero_copy_only=False)
        by_code, many = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(values))
        best, kept, before = _Best(n, k), [], 0
        for batch in _held(batches):
            keys = batch.column(0)
            run_of = np.cumsum(np.concatenate([[0], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]).astype(np.int64))
            code = pc.fill_null(pc.index_in(keys, value_set=values.cast(keys.type)), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(code >= 0)
            times = many[code[hit]]
            self_x = np.repeat(hit, times)  # pairs of an item and a query with one key
            ends = np.cumsum(times)
            self_q = by_code[np.repeat((np.cumsum(many) - many)[code[hit]], times) + np.arange(len(self_x)) - np.repeat(ends - times, times)]
            cell = batch.column(batch.num_columns - 1).to_numpy() if cells else None
            for g in _groups(batch.column(1), unit):
                alike = _alike(g.matrix) if g.finite and g.length >= 0 else np.zeros(len(g.rows), np.int64)
                some = _without_copies(alike, run_of[g.rows], k)
                for q, q32 in own:
                    if (c := q.constant(g)) is not None:
                        who = q.rows[best.cosine[q.rows, -1] <= c]
                        for lo in range(0, len(who), step := max(1, TILE // len(some))):
                            i, j = np.nonzero(codes[who[lo : lo + step], None] != code[g.rows[some]])
                            best.add(who[lo + i], np.full(len(i), c), before + g.rows[some[j]])
                        continue
                    for mine, asked in _by_cell(some, cell[g.rows[some]], block, q.rows) if cells else [(some, np.arange(len(q.rows)))]:
                        for lo in range(0, len(mine), WIDE):
                            x = mine[lo : lo + WIDE]
                            x32 = g.matrix[:, x].astype(np.float32)
                            place = np.full(batch.num_rows, -1)
                            place[g.rows[x]] = np.arange(len(x))
                            there = place[self_x] >= 0
                            out_q, out_x = self_q[there], place[self_x[there]]
                            step = max(1, TILE // len(x))
                            for a in range(0, len(asked), step):
                                who = asked[a : a + step]
                                near = q32[who] @ x32
                                spot = np.full(n, -1)
                                spot[q.rows[who]] = np.arange(len(who))
                                out = spot[out_q] >= 0
                                near[spot[out_q[out]], out_x[out]] = -9
                                i, j = _maybe(near, best.cosine[q.rows[who], -1], k, g.length)
                                i, j = who[i], x[j]
                                best.add(q.rows[i], _sums(q.matrix, g.matrix, i, j), before + g.rows[j])
            before += batch.num_rows
            kept.append(batch.drop_columns([batch.schema.names[1]]))
        if kept:
            i, j = np.nonzero(best.at >= 0)
            rows = pa.Table.from_batches(kept).take(pa.array(best.at[i, j]))
            cosine = best.cosine[i, j]
            cosine = pa.array(np.where(cosine == NAN, np.nan, cosine), mask=cosine == NULL)
            out = pa.table([block.keys.take(pa.array(i)), *rows.columns, cosine], names=["query", *rows.schema.names, "cosine"])
            yield from out.to_batches(max_chunksize=PAIRS)

    return run


def _by_cell(rows: np.ndarray, cells: np.ndarray, block: Block, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each cell, and the places of the queries that ask for it."""
    order = np.argsort(cells, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        if len(part):
            asked = np.unpackbits(block.asked[cells[part[0]]], count=len(block.keys))[queries]
            yield rows[part], np.flatnonzero(asked)


def _maybe(near: np.ndarray, kth: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest. near: cosines in single precision, of units, so that they are off by at most
    (length + 2) * 2**-24 and some; twice that is allowed for. kth: the least cosine of the k found before."""
    off = (length + 8) * 2.0**-23
    least = kth - off
    few = np.flatnonzero(kth < -2)  # fewer than k cosines that aren't null
    if len(few) and near.shape[1] > k:
        least[few] = np.partition(near[few], -k, axis=1)[:, -k] - 2 * off
    return np.nonzero(near >= np.maximum(least, -5).astype(np.float32)[:, None])


def _sums(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (i, j) of columns, summed in order of place."""
    out = np.zeros(len(i))
    for a, b in zip(q, x, strict=True):
        out += a[i] * b[j]
    return out
