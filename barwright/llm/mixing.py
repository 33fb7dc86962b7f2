"""Mixing sources to target weights (operator 4): DataFrame functions only.

Words are summed per source, targets follow from the weights, and a document of a source with repetition rate r is
taken floor(r) times and once more if its hash-seeded uniform number is below r - floor(r). Numbers lie on a circle, and
each source counts them from one of 64 places: from the one at which its taken words come nearest its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, small_side, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
STARTS = 64  # places on the circle of numbers that a source may count from


def n_words(text) -> F.Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key, seed: str) -> F.Column:
    """A number in [0, 1) from a hash of key and seed: the same in every run and on every partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sizes(source, size), one row a source.

    Sources in order of code points, null last, get the weights in turn; together they take `share` of all words, none
    more than `most` times its own, the excess being shared again by weight. With sources ordered by their limit per
    weight, those that reach it are the first k, and the rest splits what they leave: k is the first place at which
    the next source doesn't reach its limit.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    s = totals.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("left_words", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    # The level (words per weight) if just the sources before this one are at their limit.
    s = s.withColumn("level", F.when(F.col("left_words") / F.col("left_w") < F.col("limit") / F.col("w"), F.col("left_words") / F.col("left_w")))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("limit") / F.col("w"))).over(every))
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), "limit")).alias("target"))


def counted_from(number, start) -> F.Column:
    """The number in [0, 1) counted from place `start` of the circle; exact, as both are multiples of 2^-48."""
    ahead = number - start / float(STARTS)
    return F.when(ahead < 0, ahead + 1).otherwise(ahead)


def starts(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """rates(source, source_size, target, rate) with `start` for sized(source, size, number): the place to count from at
    which the words taken from the source are nearest its target, the first of several.

    Numbers are grouped into the arcs between places, each cut where an extra copy ends for the starts (all at one offset
    within their arc): 128 sums a source, made before the shuffle, tell the words that each start takes exactly.
    """
    part = F.col("rate") - F.floor("rate")
    arc = F.floor(F.col("number") * STARTS)
    below = (F.col("number") * STARTS - arc < part * STARTS - F.floor(part * STARTS)).cast("int")
    joined = sized.join(small_side(rates).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    sums = joined.groupBy("source", "source_size", "target", "rate", arc.alias("arc"), below.alias("below")).agg(F.sum("size").alias("n"))
    each = sums.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    hit = F.pmod(F.col("arc") - F.col("start"), F.lit(STARTS)) < F.floor(part * STARTS) + F.col("below")
    each = each.groupBy("source", "source_size", "target", "rate", "start").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("extra"))
    off = F.abs(F.floor("rate") * F.col("source_size") + F.col("extra") - F.col("target"))
    return each.groupBy("source", "source_size", "target", "rate").agg(F.min(F.struct(off.alias("off"), "start"))["start"].alias("start"))


def _sized(docs: DataFrame, size: str, number: str, seed: str) -> DataFrame:
    return docs.withColumn(size, n_words(F.col("text"))).withColumn(number, uniform(F.col("doc_id"), seed))


def _rated(sized: DataFrame, narrow: DataFrame, size: str, number: str, source_size: str, target: str, copies: str, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sized, which has a size and a number, with three more columns under the given names. narrow(source, size, number)
    are the same rows as a written table, so that the words of texts aren't counted again for the sums."""
    of, total, goal, rate, start = free_names([*sized.columns, source_size, target, copies], "_source", "_total", "_goal", "_rate", "_start")
    targets = source_targets(narrow, weights=weights, share=share, most=most)
    rates = written(targets.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
    chosen = written(starts(narrow, rates).toDF(of, total, goal, rate, start))
    joined = sized.join(small_side(chosen), F.col("source").eqNullSafe(F.col(of)))
    extra = (counted_from(F.col(number), F.col(start)) < F.col(rate) - F.floor(rate)).cast("long")
    taken = F.least(F.floor(rate) + extra, F.lit(most).cast("long"))
    return joined.select(*sized.columns, F.col(total).alias(source_size), F.col(goal).alias(target), taken.alias(copies))


def _mixed(docs: DataFrame, size: str, source_size: str, target: str, copies: str, *, seed: str = "mix", **options) -> DataFrame:
    """docs with four more columns under the given names, which clash with none of docs. Words are counted twice: once for
    the sums, once beside the texts that go on."""
    number = free_names([*docs.columns, size, source_size, target, copies], "_number")[0]
    sized = _sized(docs, size, number, seed)
    narrow = written(sized.select("source", F.col(size).alias("size"), F.col(number).alias("number")))
    return _rated(sized, narrow, size, number, source_size, target, copies, **options).drop(number)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each row. Columns of docs that have one of
    these names are replaced; all others stay.

    A null text has 0 words, a null source is a source of its own, a source without words has target 0 and is taken
    not at all. Rows that repeat an id share its number, so they are taken alike; so are rows without an id. No rows give
    no rows. All sums are aggregated before the shuffle, and the joined tables have one row a source, broadcast after a
    count: a source with a third of all rows is no hot group. Documents are taken whole: a source of one
    document may be as far from its target as its size.
    """
    own = ("size", "source_size", "target", "copies")
    return _mixed(docs.drop(*own), *own, **options)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs as they are, whatever their names, each row as often as it is taken. Nulls and
    repeated rows as in mix()."""
    own = free_names(docs.columns, "_size", "_source_size", "_target", "_copies")
    mixed = _mixed(docs, *own, **options)
    copy = free_names(mixed.columns, "_copy")[0]
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(own[3]).cast("int")))).select(docs.columns)


def report(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs. Words are counted once, into a narrow table that all
    sums and the result read."""
    narrow = written(_sized(docs.select("doc_id", "source", "text"), "size", "number", seed).drop("text"))
    mixed = _rated(narrow, narrow.select("source", "size", "number"), "size", "number", "source_size", "target", "copies", **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM tot),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
  (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt FROM w),
lv AS (SELECT arg_min(lt / lw, cap / w) AS level FROM o WHERE lt / lw < cap / w),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM o CROSS JOIN lv),
j AS (SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0.0::DOUBLE) AS rate,
  CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u, sized.source
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, u - k / 64.0::DOUBLE + CASE WHEN u < k / 64.0::DOUBLE THEN 1 ELSE 0 END AS v FROM j, (SELECT unnest(generate_series(0, 63)) AS k) g),
e AS (SELECT source, k, abs(any_value(floor(rate) * source_size) + coalesce(sum(size) FILTER (v < rate - floor(rate)), 0) - any_value(target)) AS off FROM c GROUP BY 1, 2),
b AS (SELECT source, k FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(rate) + CASE WHEN v < rate - floor(rate) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken FROM c JOIN b ON c.k = b.k AND c.source IS NOT DISTINCT FROM b.source
"""
