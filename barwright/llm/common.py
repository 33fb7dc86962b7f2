"""Helpers that the operators of this subpackage share: shared-folder tables, columns, word kernels.

The word kernels work on the byte buffer of a whole Arrow block with numpy: word spans by a 256-entry
table of word bytes, and 64-bit word hashes by differences of a running polynomial sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401  (operators take them from here)

# ------------------------------------------------------------------ tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to clash with none of `columns` (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


BROADCAST_ROWS = 1 << 18  # narrow rows (ids) that are broadcast at most: some MB


def small_side(ids: DataFrame, size: int | None = None) -> DataFrame:
    """A written table of ids to join texts with: broadcast if it is counted to be small, so that texts stay where they
    are; else texts are shuffled and the ids are the hashed side, so that texts aren't sorted. `size`: the narrow rows that
    it is made of, where its rows hold lists."""
    return F.broadcast(ids) if (ids.count() if size is None else size) <= BROADCAST_ROWS else ids.hint("shuffle_hash")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most 1,000 rows and 8 MB, so that long texts fit into a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


# ------------------------------------------------------------------ blocks of text

BLOCK_BYTES = 2 << 20  # text bytes worked on at once; a longer document is a block of its own


def text_array(col: pa.Array) -> pa.Array:
    if col.null_count:
        col = col.fill_null("")
    return col


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0, one more than rows) of a string array without nulls."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with at most `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffer_of(text_array(batch.column(batch.schema.get_field_index(text))))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


# ------------------------------------------------------------------ words

_ALL = np.arange(256)
#: Bytes of a word `[^\x20\x09-\x0D]+`.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one more than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = is_word[data]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        n = max(n, 1 << 20)
        _pow.update(n=n, p=np.cumprod(np.full(n, _P)), q=np.cumprod(np.full(n, _PINV)))
    return _pow["p"], _pow["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of each word's bytes after `fold`; works through the buffer in pieces of about 1 MB."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + (1 << 20) - 4096)))
        b = ends[j - 1]
        p, q = _powers(b - a)
        run = np.empty(b - a + 1, np.uint64)
        run[0] = 0
        np.cumsum((fold[data[a:b]].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=run[1:])
        out[i:j] = (run[ends[i:j] - a] - run[starts[i:j] - a]) * q[starts[i:j] - a]
        i = j
    return mix(out)


def run_hash(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive word hashes (len(words) - n + 1 of them)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(words))
    run = np.empty(len(words) + 1, np.uint64)
    run[0] = 0
    salted = mix(words ^ np.uint64((seed * 0xD6E8FEB86659FD93) & (2**64 - 1))) if seed else words
    np.cumsum(salted * p[: len(words)], out=run[1:])
    return mix((run[n:] - run[:-n]) * q[: len(words) - n + 1])


class Heavy:
    """Keys that are frequent within pieces of a task's rows: a key on a share of all documents of `share` or more
    reaches it in some piece, so it is always found. add() and rest() give (keys, counts in the piece, and the smallest
    owner of each in it)."""

    def __init__(self, share: float, least: int, piece: int = 1 << 20):
        self.share, self.least, self.piece = share, least, piece
        self.held, self.owners, self.n = [], [], 0

    def add(self, keys: np.ndarray, owner: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        self.held.append(keys)
        self.owners.append(owner)
        self.n += len(keys)
        return self.rest() if self.n >= self.piece else None

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.n:
            return None
        every, of = np.concatenate(self.held), np.repeat(np.array(self.owners, np.int64), [len(x) for x in self.held])
        keys, counts = np.unique(every, return_counts=True)
        keep = counts >= max(self.least, self.share * len(self.held))
        keys, counts = keys[keep], counts[keep]
        least = np.full(len(keys), np.iinfo(np.int64).max)
        mine = contains(keys, every)
        np.minimum.at(least, np.searchsorted(keys, every[mine]), of[mine])
        self.held, self.owners, self.n = [], [], 0
        return keys, counts, least


def heavy_keys(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` keys (columns key, n, owner) of the largest summed count, sorted, and their smallest owners: a bounded
    list, at most 16 * most bytes."""
    top = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("owner").alias("owner")).orderBy(F.desc("n"), "key").limit(most).collect()
    keys, owners = np.array([r.key for r in top], np.int64).view(np.uint64), np.array([r.owner for r in top], np.int64)
    order = np.argsort(keys)
    return keys[order], owners[order]


def contains(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))
