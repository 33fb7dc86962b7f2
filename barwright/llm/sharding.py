"""Sharding by sampled splitters (operator 8).

Keys (text hash, id) of a size-weighted sample give splitters at equal quantiles of bytes; records are partitioned by
range, many ranges to a shard. Exact sizes of the ranges (a bounded list) then place every record on one line of all
bytes, which is cut into shards of equal length: a range that a cut falls into is subdivided there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
RANGES = 64  # to a shard
SAMPLE = 64 * 1024  # keys in the sample, about
GROUP = 0.02  # a group of equal texts of at most this share of a shard (or of the longest text's size) stays whole


def splitters(keys: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """n - 1 splitters of keys(h, size) at equal quantiles of size, from a sample of about `sample` keys.

    A key is drawn with probability in proportion to its size, at most 1, by a hash of its id; one that is drawn for
    certain keeps its size as weight. The sample is bounded by twice `sample`.
    """
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return np.zeros(0, np.int64)
    step = total / sample
    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = keys.where(chance < F.col("size") / step).groupBy("h").agg(F.sum(F.greatest(F.col("size").cast("double"), F.lit(step))).alias("w")).orderBy("h").limit(2 * sample).toPandas()
    cum = np.cumsum(drawn.w.to_numpy())
    at = np.searchsorted(cum, np.arange(1, n) * (cum[-1] / n)) if len(cum) else []
    return np.unique(drawn.h.to_numpy()[at])


def shard(docs: DataFrame, *, shards: int = SHARDS, ranges: int = RANGES, group_share: float = GROUP) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs(doc_id, text); law `bytes`.

    Size: UTF-8 bytes plus 8, a null text having none. Shards follow the order of (text hash, id), so equal texts lie
    side by side and stay in one shard, unless they are more than `group_share` of a shard's bytes. Slots count from
    0 in each shard in the same order; rows equal in id and text take consecutive slots in any order.
    """
    raw = F.coalesce("text", F.lit(""))
    keys = written(docs.select(F.col("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h")))
    cuts = splitters(keys, shards * ranges)

    @F.pandas_udf("int")
    def range_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, h.to_numpy(), side="right").astype(np.int32))

    dealt = keys.withColumn("range", range_of("h"))
    # A range holds whole hashes; one hash with more than a range's share of rows is subdivided by id.
    sums = dealt.agg(F.sum("size").alias("b"), F.max("size").alias("most")).first()
    total = sums.b or 1
    whole = total / (shards * ranges)
    heavy = dealt.groupBy("range", "h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 4 * whole).select("h")
    hot = [r.h for r in heavy.limit(shards * ranges).collect()]  # at most shards * ranges / 4 hashes can be that heavy
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(64)).cast("int")
    dealt = dealt.withColumn("part", F.when(F.col("h").isin(hot), part).otherwise(F.lit(-1)))
    return _placed(dealt, total, shards, max(group_share * total / shards, sums.most or 0))


def _placed(dealt: DataFrame, total: int, shards: int, group_bytes: float) -> DataFrame:
    """Places rows(doc_id, size, text_crc32, h, range, part) on the line; groups of at most `group_bytes` stay whole. Cells (range, hash if it is hot, part) are
    ordered; a bounded table has each cell's first byte and row."""
    dealt = dealt.withColumn("hot", F.when(F.col("part") >= 0, F.col("h")))
    cell = ["range", "hot", "part"]
    table = dealt.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    line = Window.orderBy("range", F.col("hot").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*cell, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("row0"))
    on = [dealt[c].eqNullSafe(table[c]) for c in cell]
    rows = dealt.join(F.broadcast(table), on).drop(*(table[c] for c in cell))
    order = Window.partitionBy(*cell).orderBy("h", "doc_id", "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    length = total / shards
    rows = rows.withColumn("end", F.col("byte0") + F.sum("size").over(upto)).withColumn("row", F.col("row0") + F.row_number().over(order) - 1)
    same = Window.partitionBy(*cell, "h")
    first, last = F.min(F.col("end") - F.col("size")).over(same), F.max("end").over(same)
    small = (last - first <= group_bytes) & (F.col("part") < 0)
    middle = F.when(small, (first + last) / 2).otherwise(F.col("end") - F.col("size") / 2)
    rows = written(rows.select("doc_id", "size", "text_crc32", "row", F.least(F.floor(middle / F.lit(length)), F.lit(shards - 1)).cast("int").alias("shard")))
    begins = rows.groupBy("shard").agg(F.min("row").alias("row0s"))
    rows = rows.join(F.broadcast(begins), "shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row0s")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
