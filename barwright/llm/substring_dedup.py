"""Exact substring deduplication with difference-cover anchors (operator 7).

A window of 50 words that occurs in two documents holds, whatever the two positions are, an aligned run of 20 words
that starts at a position of a difference cover modulo 31 in both. So only runs at cover positions (6 of 31) are
hashed and compared over the corpus; windows around the shared ones are then hashed whole and compared exactly.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Heavy, blocks, contains, heavy_keys, long_array, mix, run_hash, small_batches, word_hashes, word_spans, written

WINDOW = 50
PERIOD = 31
HOT_LIST = 1 << 16  # at most so many frequent anchors are known beforehand as shared (512 KB sent to tasks)
HOT_SHARE = 1 / 1024


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues of which every residue modulo `period` is a difference."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)
        size += 1


def _documents(batches):
    """(rows, bytes, offsets, word starts, first word of each document, word hashes) of each block."""
    for rows, data, off in blocks(batches):
        starts, ends, first = word_spans(data, off, SPACED)
        yield rows, data, off, first, word_hashes(data, starts, ends)


def _cover(period: int, length: int) -> np.ndarray:
    full = np.zeros(period, bool)
    full[list(difference_cover(period))] = True
    return np.tile(full, length // period + 1)[:length]


def _key(words: np.ndarray) -> int:
    return int(run_hash(words, len(words))[0]) if len(words) else 0


def _scan(window: int, period: int):
    """kind 0: doc_id, th, n_words, whole (sha256 of the words joined by one space), c; kind 1: a locally frequent anchor
    in c and its count in n_words."""
    length, names = window - period + 1, ["kind", "doc_id", "th", "n_words", "whole", "c"]

    def frequent(found):
        if found is not None and len(found[0]):
            n = len(found[0])
            zero = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), zero, zero, long_array(found[1]), pa.nulls(n, pa.string()), long_array(found[0])], names)

    def run(batches):
        heavy, seen = Heavy(HOT_SHARE, 8), set()
        for rows, data, off, first, words in _documents(batches):
            runs, whole, keys, raw = run_hash(words, length), [], [], data.tobytes()
            for d in range(rows.num_rows):
                a, b = first[d], first[d + 1]
                sha = hashlib.sha256(b" ".join(raw[off[d] : off[d + 1]].split())).hexdigest()
                whole.append(sha)
                keys.append(_key(words[a:b]))
                if b - a >= window and sha not in seen:
                    seen.add(sha)
                    yield from frequent(heavy.add(np.unique(runs[a : b - length + 1][_cover(period, b - a - length + 1)])))
            if len(seen) > 1 << 18:
                seen.clear()
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), rows.column(0), rows.column(2), pa.array(np.diff(first)), pa.array(whole), long_array(np.array(keys, np.uint64))], names)
        yield from frequent(heavy.rest())

    return run


def _anchors(hot: np.ndarray, window: int, period: int):
    """(h, c, pos, known): the anchors of each word sequence c, once in a task. Frequent ones are known to be shared;
    their key is spread, so that they don't meet in one task."""
    length = window - period + 1

    def run(batches):
        seen = set()
        for _, _, _, first, words in _documents(batches):
            runs, h, c, pos = run_hash(words, length), [], [], []
            for d in range(len(first) - 1):
                a, b = first[d], first[d + 1]
                if b - a < window:
                    continue
                key = (_key(words[a:b]), int(words[a:b].sum(dtype=np.uint64)))
                if key in seen:
                    continue
                seen.add(key)
                at = np.flatnonzero(_cover(period, b - a - length + 1))
                h.append(runs[a + at])
                c.append(np.full(len(at), key[0], np.uint64))
                pos.append(at)
            if len(seen) > 1 << 20:
                seen.clear()
            if h:
                h, c, pos = np.concatenate(h), np.concatenate(c), np.concatenate(pos)
                known = contains(hot, h)
                h = np.where(known, mix(h ^ c + pos.astype(np.uint64)), h)
                yield pa.RecordBatch.from_arrays([long_array(h), long_array(c), pa.array(pos.astype(np.int32)), pa.array(known)], ["h", "c", "pos", "known"])

    return run


def _once(batches):
    """Rows that repeat id and class once in a task."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
        yield batch.filter(pa.array([k not in seen and not seen.add(k) for k in keys], pa.bool_()))


def _windows(window: int, period: int):
    """(w1, w2, doc_id, part, pos): every window around a shared anchor."""
    back = period - 1

    def run(batches):
        for rows, _, _, first, words in _documents(batches):
            one, two, out = run_hash(words, window), run_hash(words, window, seed=1), []
            for d, (doc, marks, part) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2), rows.column(4).to_pylist(), strict=True)):
                n = int(first[d + 1] - first[d])
                if n < window:
                    continue
                q = marks.values.to_numpy(zero_copy_only=False).astype(np.int64)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, np.maximum(q - back, 0), 1)
                np.add.at(step, np.minimum(q, n - window) + 1, -1)
                at = np.flatnonzero(np.cumsum(step[: n - window + 1]) > 0)
                out.append((one[first[d] + at], two[first[d] + at], np.full(len(at), doc, np.int64), np.full(len(at), part, np.int64), at))
            if out:
                w1, w2, doc, part, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([long_array(w1), pa.array((w2 >> np.uint64(33)).astype(np.int32)), pa.array(doc), pa.array(part), pa.array(at.astype(np.int32))], ["w1", "w2", "doc_id", "part", "pos"])

    return run


def _cut(window: int):
    """(doc_id, c, n_removed, kept_sha256, removed): what stays of documents with repeated windows at pos."""

    def run(batches):
        for batch in batches:
            ids, removed, kept, spans = batch.column(0), [], [], []
            for text, pos in zip(batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                at = pos.values.to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(compress(words, ~gone))).hexdigest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["cut_id", "cut_c", "n_removed", "kept_sha256", "removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed): for each row of docs the words that are covered by a window
    whose word sequence also starts in a document of smaller id; removed has them as spans of word positions.

    Null and wordless texts have no words; documents shorter than a window keep all. Rows that repeat an id aren't
    smaller than one another and keep what only they share, whatever their texts. Rows without an id keep all and take
    nothing from others. Other columns aren't read. No rows give no rows.
    """
    if not 0 < period < window:
        raise ValueError("period must be less than window")
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(text.withColumn("th", F.xxhash64("text")).mapInArrow(_scan(window, period), "kind int, doc_id long, th long, n_words long, whole string, c long"))
    hot, _ = heavy_keys(found.where("kind = 1").select(F.col("c").alias("key"), F.col("n_words").alias("n"), F.lit(0).cast("long").alias("owner")), HOT_LIST)
    rows = found.where("kind = 0").drop("kind")
    # Equal word sequences: all but the smallest id are repeats as a whole; th names the text to read it from.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    firsts = written(rows.where(F.col("n_words") >= window).groupBy("whole", "c").agg(least.alias("f")).select("whole", "c", F.col("f.doc_id").alias("first_id"), F.col("f.th").alias("th")))

    # Anchors that two sequences have: aggregated before the exchange, and joined back as a stage of its own, whose
    # frequent anchors Spark can split. Those known beforehand have spread keys and meet nothing.
    anchors = text.mapInArrow(_anchors(hot, window, period), "h long, c long, pos int, known boolean")
    shared = written(anchors.where("not known").groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h", F.lit(True).alias("shared")))
    marks = anchors.join(shared, "h", "left").where("known or shared").groupBy("c").agg(F.collect_set("pos").alias("marks"))
    # An id can have several texts: c tells them apart, and part does in windows, where it is 0 for ids with one.
    several = firsts.groupBy("first_id").agg(F.count("*").alias("k")).where("k > 1").select("first_id", F.lit(True).alias("several"))
    need = marks.join(firsts.where("first_id is not null"), "c").join(several, "first_id", "left")
    need = need.select(F.col("first_id").alias("doc_id"), F.col("th").alias("_th"), "marks", "c", F.when(F.col("several"), F.col("c")).otherwise(F.lit(0).cast("long")).alias("part"))
    texts = text.withColumn("_th", F.xxhash64("text")).join(need.hint("shuffle_hash"), ["doc_id", "_th"]).select("doc_id", "text", "marks", "c", "part")
    texts = written(texts.mapInArrow(_once, "doc_id long, text string, marks array<int>, c long, part long"))

    windows = texts.mapInArrow(_windows(window, period), "w1 long, w2 int, doc_id long, part long, pos int")
    # Written, so that the join below is a stage of its own, whose hot windows Spark can split.
    least = written(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
    repeats = windows.join(least, ["w1", "w2"]).where("doc_id > lo").groupBy("doc_id", "part").agg(F.collect_set("pos").alias("pos"))
    cut = texts.select("doc_id", "text", "c", "part").join(repeats, ["doc_id", "part"]).select("doc_id", "c", "text", "pos").mapInArrow(_cut(window), "cut_id long, cut_c long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>")
    cut = cut.dropDuplicates(["cut_id", "cut_c"])  # rows that repeat id and text, and two sequences that collide in c

    spans = "array<struct<start:int,end:int>>"
    copy = F.col("first_id") < F.col("doc_id")
    out = rows.join(firsts, ["whole", "c"], "left").join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("c") == F.col("cut_c")), "left")
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).cast(spans)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.coalesce("removed", F.array().cast(spans))).alias("removed"),
    )
