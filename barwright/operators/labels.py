"""Labels: coercion, checks, duplicates, filters and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_of
from ..functions.scalars import clean_key, free_name, sample_key, to_bool
from ..sources.shared import written
from . import calendar


def normalized(raw: DataFrame) -> DataFrame:
    """raw(ticker, date, setup, label, ...) as text: upper-case tickers, dates and booleans coerced, NULL where they
    can't be, and the sample_id. Further columns pass."""
    need = {"ticker", "date", "setup", "label"} - set(raw.columns)
    if need:
        raise ValueError(f"columns are missing: {sorted(need)}")
    rest = [c for c in raw.columns if c not in ("ticker", "date", "setup", "label")]
    df = raw.select(clean_key("ticker").alias("ticker"), F.try_to_date("date", "yyyy-MM-dd").alias("asof_date"), F.trim("setup").alias("setup"), to_bool("label").alias("label"), *rest)
    return df.withColumn("sample_id", sample_key("ticker", "asof_date", "setup"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labels or listings with a header: all columns as text, so that a ticker `NA` stays one."""
    return spark.read.option("header", True).option("inferSchema", False).option("nullValue", "").csv(path)


def write_store(df: DataFrame, path: str, source: str | None = None) -> None:
    """Labels as Parquet, and a sidecar of one JSON row beside it: source, rows, columns and keys."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"))
    names = F.array(*(F.lit(c) for c in df.columns))
    keys = F.array(*(F.lit(c) for c in ("ticker", "asof_date", "setup")))
    n.select(F.lit(source).alias("source"), "rows", names.alias("columns"), keys.alias("key_columns")).coalesce(1).write.mode("overwrite").json(f"{path}.meta.json")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a store; an error if a column that they need is missing."""
    df = spark.read.parquet(path)
    need = {"ticker", "asof_date", "setup", "label"} - set(df.columns)
    if need:
        raise ValueError(f"columns are missing: {sorted(need)}")
    return df


def boolean_columns(df: DataFrame, columns: list[str], sample: int = 50) -> list[str]:
    """Columns whose first `sample` non-null values all are booleans: one bounded job for each column."""
    found = []
    for c in columns:
        seen = df.where(F.col(c).isNotNull()).select(to_bool(c).isNull().alias("bad")).limit(sample).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
        if seen.n and not seen.bad:
            found.append(c)
    return found


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str], shown: int = 10) -> DataFrame:
    """(rule, n, example): rows that break each rule, counted in one pass, with up to `shown` keys of them in order."""
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    hits = df.select(key.alias("example"), F.explode(F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())).alias("rule"))
    counted = hits.groupBy("rule").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("rule").orderBy("example"))
    return hits.withColumn("rn", rn).where(F.col("rn") <= shown).join(F.broadcast(counted), "rule").select("rule", "n", "example", "rn")


def keyed_violations(df: DataFrame, *, unique: list[str] | None = None, date: str | None = None, sessions: DataFrame | None = None, rows_of: str | None = None, n_rows: int | None = None, shown: int = 10) -> DataFrame:
    """(rule, n, example, rn) as violations gives, of rules that rows can't show one by one: `duplicate_key` (values of `unique`
    in several rows), `not_a_session` (rows whose `date` isn't in sessions; a null date is none) and `wrong_row_count`
    (values of rows_of that haven't n_rows rows). Rules whose columns aren't given aren't checked."""
    name = lambda cols: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    parts = []
    if unique:
        parts.append(df.groupBy(*unique).count().where("count > 1").select(F.lit("duplicate_key").alias("rule"), F.lit(1).cast("bigint").alias("n"), name(unique).alias("example")))
    if date and sessions is not None:
        days = df.groupBy(date).agg(F.count("*").alias("n")).join(sessions.select(F.col("date").alias(date)).distinct(), date, "left_anti")
        parts.append(days.select(F.lit("not_a_session").alias("rule"), "n", name([date]).alias("example")))
    if rows_of and n_rows is not None:
        parts.append(df.groupBy(rows_of).count().where(F.col("count") != n_rows).select(F.lit("wrong_row_count").alias("rule"), F.lit(1).cast("bigint").alias("n"), name([rows_of]).alias("example")))
    if not parts:
        raise ValueError("no rule is given")
    hits = reduce(DataFrame.unionByName, parts)
    totals = hits.groupBy("rule").agg(F.sum("n").alias("n"))
    rn = F.row_number().over(Window.partitionBy("rule").orderBy("example"))
    top = hits.select("rule", "example").withColumn("rn", rn).where(F.col("rn") <= shown)
    return top.join(F.broadcast(totals), "rule").select("rule", "n", "example", "rn")


#: Columns of labels that aren't attributes: they are never taken for booleans.
KNOWN = ("ticker", "asof_date", "setup", "label", "weight", "p_label", "label_def_version", "lf_config_hash", "fold", "split", "source", "notes", "created_ts", "sample_id")
RESOLVE = ("error", "previous", "next")
DEDUPE = ("error", "keep_first", "keep_last")


def _refused(bad: DataFrame) -> None:
    rows = bad.orderBy("rule", "rn").collect()  # some examples of each rule
    if rows:
        said = {r.rule: f"{r.rule}: {r.n} ({', '.join(x.example for x in rows if x.rule == r.rule)})" for r in rows}
        raise ValueError("labels are refused: " + "; ".join(said.values()))


def load(raw: DataFrame, sessions: DataFrame, *, resolve: str = "error", dedupe: str = "error", order: str | None = None) -> DataFrame:
    """Labels of raw(ticker, date, setup, label, ...), all text, as one job: coerced, checked, their dates resolved, duplicates
    treated, and named by a sample_id.

    Rows with a date or label that can't be read, or without a ticker or setup, refuse the whole load, with their number
    and examples; so do dates that aren't sessions, if `resolve` is `error` (else they become the session before or the
    next, within ten days; without one the load is refused), and repeated (ticker, asof_date, setup), if `dedupe` is `error`
    (else the first or last by `order` stays; without an order, as read). weight and p_label become doubles, fold a
    number, split lower case; further columns whose first values are all booleans become booleans. No rows are an error.
    """
    if resolve not in RESOLVE or dedupe not in DEDUPE:
        raise ValueError(f"resolve must be one of {RESOLVE}, dedupe one of {DEDUPE}")
    at = free_name(raw.columns, "_order")
    rows = raw.withColumn(at, F.col(order) if order else F.monotonically_increasing_id())
    df = written(normalized(rows).drop("sample_id"))
    if df.limit(1).count() == 0:
        raise ValueError("there are no labels")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {"bad_date": F.col("asof_date").isNull(), "bad_label": F.col("label").isNull(), "no_setup": blank("setup"), "no_ticker": blank("ticker")}
    _refused(violations(df, rules, ["ticker", "asof_date", "setup"]))
    if resolve != "error":
        found = calendar.resolve(df.select(F.col("asof_date").alias("d")).distinct(), sessions)
        found = found.select(F.col("d").alias("asof_date"), F.col("last_session" if resolve == "previous" else "next_session").alias("_to"))
        df = written(df.join(found, "asof_date", "left").withColumn("asof_date", F.coalesce("_to", "asof_date")).drop("_to"))
    _refused(keyed_violations(df, date="asof_date", sessions=sessions))
    keys = ["ticker", "asof_date", "setup"]
    if dedupe == "error":
        _refused(keyed_violations(df, unique=keys))
    else:
        df = deduped(df.withColumn("_k", F.col(at)), keys, "_k", dedupe.removeprefix("keep_")).drop("_k")
    df = df.drop(at)
    number = lambda c, kind: F.col(c).cast("string").try_cast("double").try_cast(kind)
    kinds = {"weight": number("weight", "double"), "p_label": number("p_label", "double"), "fold": number("fold", "bigint") if "fold" in df.columns else None, "split": F.lower(F.trim("split"))}
    df = df.withColumns({c: v for c, v in kinds.items() if c in df.columns})
    flags = boolean_columns(df, [c for c in df.columns if c.lower() not in KNOWN])
    df = df.withColumns({c: to_bool(c) for c in flags})
    return df.withColumn("sample_id", sample_key("ticker", "asof_date", "setup"))


def deduped(df: DataFrame, keys: list[str], order: str, keep: str = "first") -> DataFrame:
    """One row of each key, the first or last by `order`; keep `error` fails the job if a key repeats."""
    if keep == "error":
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit("duplicate keys")).isNull()).drop("_n")
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def filtered(df: DataFrame, setup: str = "all", tickers: tuple[str, ...] = ()) -> DataFrame:
    if setup != "all":
        df = df.where(F.col("setup") == setup)
    return df.where(clean_key("ticker").isin(*[t.strip().upper() for t in tickers])) if tickers else df


def _split(rank: Column, n: Column, train: float, val: float) -> Column:
    a, b = F.bround(n * F.lit(train)), F.bround(n * F.lit(val))
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def ranked(df: DataFrame, order: list[Column], out: str = "rank", *, kind: str = "bigint") -> DataFrame:
    """df with its global rank by `order`, in two steps so that no task holds all rows: ranges of the order are dealt to
    partitions, ranked there, and shifted by the rows of the ranges before (one small row a range)."""
    dated = df.select(order[0].alias("k")).dtypes[0][1] == "date"
    df = df.withColumn("_p", range_of(df, F.unix_date(order[0]) if dated else order[0], "bigint" if dated else kind))
    before = df.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return df.withColumn(out, local).join(F.broadcast(before), "_p").withColumn(out, F.col(out) + F.col("_before")).drop("_p", "_before")


def split_time(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Oldest rows train, the next validate, the rest tests; ties in order of ticker and setup."""
    n = df.agg(F.count("*").alias("_n"))
    rows = ranked(df, [F.col("asof_date"), F.col("ticker"), F.col("setup")]).crossJoin(F.broadcast(n))
    return rows.withColumn("split", _split(F.col("rank"), F.col("_n"), train, val)).drop("rank", "_n")


def split_random(df: DataFrame, seed: int = 7, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """As split_time, in the order of a hash of seed and sample_id."""
    n = df.agg(F.count("*").alias("_n"))
    h = F.sha1(F.concat_ws("|", F.lit(str(seed)), "sample_id").cast("binary"))
    number = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    rows = ranked(df.withColumn("_h", number).withColumn("_hs", h), [F.col("_h"), F.col("_hs"), F.col("sample_id")]).crossJoin(F.broadcast(n))
    return rows.withColumn("split", _split(F.col("rank"), F.col("_n"), train, val)).drop("rank", "_n", "_h", "_hs")


def split_column(df: DataFrame, column: str) -> DataFrame:
    """A given split column in lower case; other words than train, val and test become NULL."""
    s = F.lower(F.trim(column))
    return df.withColumn("split", F.when(s.isin("train", "val", "test"), s))
