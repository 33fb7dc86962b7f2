"""Fixed-length windows of bars: masked samples, contexts, dense rows, and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import planned

VALUES = ("open", "high", "low", "close", "volume")


def _joined(plan: DataFrame, bar: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return plan.join(bar.select("ticker", F.col("date").alias("bar_date"), *columns), ["ticker", "bar_date"], "left")


def once(df: DataFrame, key: str) -> DataFrame:
    """df, whose job fails if a value of `key` repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.concat(F.lit(f"{key} repeats: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).isNull()).drop("_n")


def windowed(samples: DataFrame, sessions: DataFrame, bar: DataFrame, size: int, columns: tuple[str, ...] = VALUES, *, unique: bool = True) -> DataFrame:
    """size rows for each sample, t = 0 .. size - 1, the last one being the as-of session, of which only `open` stays: nothing
    that isn't known at the open leaks. Missing bars are rows of NULLs; other columns of samples repeat. `unique` fails the
    job if a sample_id repeats."""
    if unique:
        samples = once(samples, "sample_id")
    rows = _joined(planned(samples, sessions, size), bar, columns).withColumn("t", F.col("t_rel") + (size - 1)).drop("t_rel")
    seen = F.col("bar_date") < F.col("asof_date")
    return rows.withColumns({c: F.when(seen, F.col(c)) for c in columns if c != "open"})


def context(samples: DataFrame, sessions: DataFrame, bar: DataFrame, past: int, future: int) -> DataFrame:
    """Rows t_rel = -past + 1 .. future around each sample, nothing masked."""
    return _joined(planned(samples, sessions, past, future), bar, VALUES)


def dense(rows: DataFrame, size: int, keep: tuple[str, ...] = ("ticker", "asof_date", "setup", "label"), columns: tuple[str, ...] = VALUES) -> DataFrame:
    """One row for each sample: `bars`, an array of structs in order of t. Fails if a sample hasn't exactly `size` rows."""
    bars = F.array_sort(F.collect_list(F.struct("t", *columns)))
    out = rows.groupBy("sample_id").agg(bars.alias("bars"), *(F.first(c).alias(c) for c in keep))
    return out.where(F.assert_true(F.size("bars") == size, F.lit(f"a sample hasn't {size} rows")).isNull())


def sliding(bar: DataFrame, sizes: tuple[int, ...], stride: int) -> DataFrame:
    """Windows of each ticker's rows: (window_id, ticker, start_date, end_date, window_size, stride, start_idx, end_idx,
    end_year_month), starting at rows 0, stride, 2 stride ..."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bar.select("ticker", "date", (F.row_number().over(w) - 1).alias("start_idx"), *(F.lead("date", n - 1).over(w).alias(f"_e{n}") for n in sizes))
    ends = F.explode(F.array(*(F.struct(F.lit(n).alias("window_size"), F.col(f"_e{n}").alias("end_date")) for n in sizes)))
    out = rows.where(F.col("start_idx") % stride == 0).select("ticker", F.col("date").alias("start_date"), "start_idx", ends.alias("e")).select("*", "e.*").drop("e").where("end_date is not null")
    out = out.withColumn("end_idx", F.col("start_idx") + F.col("window_size") - 1).withColumn("stride", F.lit(stride))
    name = F.format_string("%s|%s|%s|L=%d|stride=%d|i0=%d|i1=%d", F.upper("ticker"), F.col("start_date").cast("string"), F.col("end_date").cast("string"), "window_size", "stride", "start_idx", "end_idx")
    return out.withColumn("window_id", F.substring(F.sha1(name.cast("binary")), 1, 16)).withColumn("end_year_month", F.date_format("end_date", "yyyy-MM"))


def numbered_rows(bar: DataFrame) -> DataFrame:
    """bar with idx, the place of each row in its ticker's line, from 0."""
    return bar.withColumn("idx", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def window_rows(bar: DataFrame, wins: DataFrame) -> DataFrame:
    """The rows of sliding windows(window_id, ticker, window_size, start_idx, end_idx), with idx and pos, their place in the
    window."""
    keys = wins.select("window_id", "ticker", "window_size", "start_idx", F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    return keys.join(numbered_rows(bar), ["ticker", "idx"]).withColumn("pos", F.col("idx") - F.col("start_idx"))


def open_only_last(rows: DataFrame, pos: str, size, columns: tuple[str, ...] = VALUES) -> DataFrame:
    """Rows of windows with only `open` left at the last position."""
    return rows.withColumns({c: F.when(F.col(pos) < size - 1, F.col(c)) for c in columns if c != "open"})


def _permuted(i: Column, bits: int, seed: int, rounds: int = 4) -> Column:
    """A permutation of the numbers of 2 * bits bits (a Feistel network of hashes)."""
    half = 1 << bits
    left, right = F.shiftright(i, bits), i.bitwiseAND(F.lit(half - 1))
    for k in range(rounds):
        h = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(f"{seed}|{k}"), right.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
        left, right = right, left.bitwiseXOR(h.bitwiseAND(F.lit(half - 1)))
    return F.shiftleft(left, bits).bitwiseOR(right)


def sampled_pairs(tickers: DataFrame, sessions: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct (ticker, date) pairs of the given tickers and dates (all of them if there are fewer), the same ones in every
    run, drawn without listing all pairs.

    Pairs are numbered: a ticker's place by its hash, times the number of dates, plus the date's place. A keyed permutation
    of numbers up to the next power of four, of which every fourth at least is a pair, gives the first n that are one.
    Null tickers and dates are none.
    """
    spark = tickers.sparkSession
    names = numbered(tickers.select("ticker").where("ticker is not null").distinct(), F.col("ticker"), "_t")
    days = sessions.select("date").where("date is not null").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")) - 1)  # a calendar
    n_days = days.count()
    total = names.count() * n_days
    if not total:
        return names.select("ticker").crossJoin(days.select("date").limit(0))
    bits = max(1, -(-(total - 1).bit_length() // 2))
    space, drawn = 1 << (2 * bits), 0
    n = min(n, total)
    upto = min(space, n * space // total + 64)
    while True:
        numbers = spark.range(upto).withColumn("_p", _permuted(F.col("id"), bits, seed)).where(F.col("_p") < total)
        drawn = numbers.count()
        if drawn >= n or upto >= space:
            break
        upto = min(space, 2 * upto)
    picked = numbers.orderBy("id").limit(n).select(F.floor(F.col("_p") / n_days).cast("bigint").alias("_t"), F.pmod("_p", F.lit(n_days)).cast("int").alias("_d"))
    return picked.join(names, "_t").join(days, "_d").select("ticker", "date")


def numbered(df: DataFrame, order: Column, out: str) -> DataFrame:
    """df with the place of each row by the SHA-1 of `order`, from 0; no task holds all rows (labels.ranked)."""
    from .labels import ranked

    h = F.sha1(order.cast("binary"))
    df = df.withColumn("_h", F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")).withColumn("_hs", h)
    return ranked(df, [F.col("_h"), F.col("_hs")], out).withColumn(out, (F.col(out) - 1).cast("bigint")).drop("_h", "_hs")


def fingerprint(keys: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, digest) that names a set of keys whatever its order and partitions: their number, and a hash of two sums of
    60-bit hashes. Repeated keys count as often as they are there."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    h = F.sha1(text.cast("binary"))
    part = lambda k: F.sum(F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(20,0)"))
    sums = keys.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return sums.select("n", F.sha1(F.concat_ws("|", F.col("n").cast("string"), zero("a"), zero("b")).cast("binary")).alias("digest"))


def write_sample(pairs: DataFrame, path: str, columns: tuple[str, ...] = ("ticker", "date")) -> None:
    """Pairs as Parquet, and their fingerprint as a row of JSON beside them."""
    pairs.write.mode("overwrite").parquet(path)
    fingerprint(pairs.sparkSession.read.parquet(path), list(columns)).coalesce(1).write.mode("overwrite").json(f"{path}.meta.json")
