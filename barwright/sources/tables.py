"""Bars, sessions, universe and samples from the given tables, and readers for outside formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_key, exchange_of, no_nan, sample_key

BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume bigint, adj_close double, source string, asof_ts timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each brand: one pass over its line items, aggregated before the shuffle."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    at = F.struct("l_orderkey", "l_linenumber", "px")
    return items.join(parts, "l_partkey").groupBy("ticker", "date").agg(F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))


def sessions(bar: DataFrame) -> DataFrame:
    """(date, session_no) of all dates with bars: a calendar, thousands of rows at most."""
    return bar.select("date").distinct().withColumn("session_no", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_name").alias("ticker"), F.col("n_name").alias("name"), F.col("r_name").alias("exchange"), (F.col("s_acctbal") < 0).alias("is_etf"), (F.col("s_suppkey") % 17 == 0).alias("is_test_issue"), "s_suppkey")


def samples(bar: DataFrame) -> DataFrame:
    """Labelled samples: bars of the 15th of a month."""
    setup = F.when(F.month("date") % 2 == 0, F.lit("flag")).otherwise(F.lit("gap"))
    rows = bar.where(F.dayofmonth("date") == 15).select("ticker", F.col("date").alias("asof_date"), setup.alias("setup"), (F.col("close") > F.col("open")).alias("label"))
    return rows.select(sample_key("ticker", "asof_date", "setup").alias("sample_id"), "*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, setup, y_true, score) to measure scores on: labels with a score from the text's length."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("setup"), ((F.col("n_chars") % 97) / 97.0).alias("score"))
    return labels.join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("sample_id"), "setup", "y_true", "score")


# ------------------------------------------------------------------ outside formats


def write_bars(bar: DataFrame, path: str) -> None:
    """Bars as Parquet with one folder a date; a date's rows go to one task first, so that each folder has one file."""
    bar.repartition("date").write.mode("overwrite").option("compression", "zstd").partitionBy("date").parquet(path)


def read_bars(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Bars of a Parquet folder with one folder a date; a span (inclusive) prunes folders, whose names sort as dates do.
    Folders that name no date are left out."""
    df = spark.read.schema("ticker string, open double, high double, low double, close double, volume bigint, date string").parquet(path)
    df = df.where(F.try_to_date("date", "yyyy-MM-dd").isNotNull())
    if since:
        df = df.where(F.col("date") >= since)
    if until:
        df = df.where(F.col("date") <= until)
    return df.withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))


def partition_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(date, n_files, bytes) of a folder of bars: names and sizes of files, whose contents aren't read. Folders that name
    no date go."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")
    date = F.try_to_date(F.regexp_extract("path", r"/date=(\d{4}-\d{2}-\d{2})/[^/]*$", 1), "yyyy-MM-dd")
    return files.select(date.alias("date"), "length").where("date is not null").groupBy("date").agg(F.count("*").cast("int").alias("n_files"), F.sum("length").alias("bytes"))


def bars_from_json(payloads: DataFrame) -> DataFrame:
    """Bars of grouped-daily payloads(date, value: JSON text): results exploded, tickers upper-cased, numbers coerced, a
    missing volume is 0, rows without ticker, date or close go, the last of each (ticker, date) stays."""
    kind = "struct<status:string,adjusted:boolean,results:array<map<string,string>>>"  # the keys T and t differ by case
    r = payloads.select("date", F.from_json("value", kind).alias("p")).select("date", "p.adjusted", F.posexplode("p.results").alias("pos", "r"))
    get = lambda c: F.try_element_at("r", F.lit(c))
    num = lambda c: get(c).try_cast("double")
    rows = r.select(clean_key(get("T")).alias("ticker"), "date", num("o").alias("open"), num("h").alias("high"), num("l").alias("low"), num("c").alias("close"), F.coalesce(num("v"), F.lit(0.0)).cast("bigint").alias("volume"), num("vw").alias("vwap"), num("n").alias("transactions"), "adjusted", "pos")
    rows = rows.where("ticker is not null and ticker <> '' and date is not null and close is not null")
    return last_of(rows, ["ticker", "date"], "pos").drop("pos")


#: Fixed value: the first line of a vendor's answer with bars.
CSV_HEADER = "Date,Open,High,Low,Close,Volume"
#: What a vendor's answer without bars says.
NO_DATA = ("no data", "brak danych")


def bars_from_csv(answers: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of vendor answers(ticker, value: the whole text), whose first line must be CSV_HEADER. A null or blank answer and
    one that says that there is no data give no rows; any other first line fails the job with the answer's start.

    Lines without a date or close go, other values that aren't numbers are NULL, a missing volume is 0, the span [start,
    end] is inclusive, the last line of each (ticker, date) stays.
    """
    lines = F.split(F.btrim(F.regexp_replace(F.coalesce("value", F.lit("")), "\r", ""), F.lit(" \n\t")), "\n")
    first = F.trim(F.get(lines, F.lit(0)))
    nothing = (first == "") | F.lower(first).rlike("|".join(NO_DATA))
    odd = F.raise_error(F.concat(F.lit("an answer isn't bars: "), F.coalesce("ticker", F.lit("?")), F.lit(": "), F.substring("value", 1, 200)))
    rest = F.when(first == CSV_HEADER, F.slice(lines, F.lit(2), F.size(lines))).when(nothing, F.array().cast("array<string>")).otherwise(odd.cast("array<string>"))
    r = answers.select("ticker", F.posexplode(rest).alias("pos", "line"))
    r = r.select("ticker", "pos", F.from_csv("line", "Date string, Open string, High string, Low string, Close string, Volume string", {"mode": "PERMISSIVE"}).alias("r"))
    num = lambda c: no_nan(F.col(f"r.{c}").try_cast("double"))
    rows = r.select(clean_key("ticker").alias("ticker"), F.try_to_date("r.Date", "yyyy-MM-dd").alias("date"), num("Open").alias("open"), num("High").alias("high"), num("Low").alias("low"), num("Close").alias("close"), F.coalesce(num("Volume"), F.lit(0.0)).cast("bigint").alias("volume"), "pos")
    rows = rows.where("date is not null and close is not null")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return last_of(rows, ["ticker", "date"], "pos").drop("pos")


@dataclass(frozen=True)
class Listing:
    """Names of a listing file's columns; `exchange` is a column of codes, `market` the exchange of a file without one."""

    ticker: str
    exchange: str | None
    market: str | None
    rank: int
    name: str = "Security Name"
    etf: str = "ETF"
    test: str = "Test Issue"

    def needed(self) -> list[str]:
        return [c for c in (self.ticker, self.name, self.exchange, self.etf, self.test) if c]


#: Layouts of the two listing files. A ticker of both is taken from the one of the lower rank.
LISTINGS = (Listing("Symbol", None, "NASDAQ", 0), Listing("ACT Symbol", "Exchange", None, 1))


def symbol_directory(lines: DataFrame) -> DataFrame:
    """(ticker, name, exchange, is_etf, is_test_issue, source_rank, file) of pipe-separated lines(file, value).

    A file's header is its line with a field `Security Name`; it tells the layout (LISTINGS) and where each column is, so
    columns may stand in any order and others between them. A file without a header, of no known layout or without a
    column that its layout needs fails the job. Blank lines, the footer and rows without a ticker go.
    """
    part = F.transform(F.split(F.trim("value"), r"\|"), lambda x: F.trim(x))
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("File Creation Time:")).select("file", part.alias("part"))
    is_header = F.array_contains("part", F.lit("Security Name"))
    headers = rows.where(is_header).groupBy("file").agg(F.first("part").alias("header"))  # a row a file
    rows = rows.where(~is_header).join(F.broadcast(headers), "file", "left")
    has = lambda c: F.array_contains("header", F.lit(c))
    stop = lambda what: F.raise_error(F.concat(F.col("file"), F.lit(what))).cast("int")
    layout = F.when(F.col("header").isNull(), stop(": no header"))
    for k, x in enumerate(LISTINGS):
        whole = F.forall(F.array(*(F.lit(c) for c in x.needed())), lambda c: F.array_contains("header", c))
        layout = layout.when(has(x.ticker), F.when(whole, F.lit(k)).otherwise(stop(f": one of {', '.join(x.needed())} is missing")))
    rows = rows.withColumn("layout", layout.otherwise(stop(": no known layout")))
    at = lambda c: F.get("part", (F.array_position("header", F.lit(c)) - 1).cast("int"))
    by_layout = lambda of: F.coalesce(*(F.when(F.col("layout") == k, of(x)) for k, x in enumerate(LISTINGS)))
    flag = lambda name: F.coalesce(by_layout(lambda x: F.upper(at(getattr(x, name))) == "Y"), F.lit(False))
    exchange = by_layout(lambda x: exchange_of(at(x.exchange)) if x.exchange else F.lit(x.market))
    out = rows.select(F.upper(by_layout(lambda x: at(x.ticker))).alias("ticker"), by_layout(lambda x: at(x.name)).alias("name"), exchange.alias("exchange"), flag("etf").alias("is_etf"), flag("test").alias("is_test_issue"), by_layout(lambda x: F.lit(x.rank)).alias("source_rank"), "file")
    return out.where("ticker <> ''")


def read_symbol_directory(spark: SparkSession, path: str) -> DataFrame:
    """Listings of all files of a folder."""
    return symbol_directory(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value"))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, as an aggregate: rows meet half-reduced."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
