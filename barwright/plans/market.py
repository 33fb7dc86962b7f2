"""Queries on bars, the calendar and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import by, ema_array, full_mean, full_std, true_range
from ..functions.scalars import ratio, rounded, vendor_symbol
from ..operators import bars as B
from ..operators import calendar as C
from ..operators import universe as U
from ..operators import labels as L
from ..sources import runs as R
from ..sources import tables as S
from ..sources.shared import shared_dir
from . import registry
from .registry import query
from .sql import r, rs, with_

FEAT = ("ret_1d", "ret_5d", "ret_21d", "vol_avg_20", "dollar_vol_avg_20", "range_pct")
PX = ("open", "high", "low", "close")


def feats(spark, sf):
    return B.features(S.bars(spark, sf))


def with_rounded(df, *cols, places=6):
    return df.withColumns({c: rounded(c, places) for c in cols})


@query(with_("feat") + f"SELECT ticker, date, {rs('ret_1d', 'ret_5d', 'ret_21d')} FROM feat")
def returns(spark, sf):
    return with_rounded(feats(spark, sf).select("ticker", "date", "ret_1d", "ret_5d", "ret_21d"), "ret_1d", "ret_5d", "ret_21d")


@query(with_("feat") + f"SELECT ticker, date, {rs('vol_avg_20', 'dollar_vol_avg_20', places=4)} FROM feat")
def liquidity_avgs(spark, sf):
    return with_rounded(feats(spark, sf).select("ticker", "date", "vol_avg_20", "dollar_vol_avg_20"), "vol_avg_20", "dollar_vol_avg_20", places=4)


@query(with_("last") + f"SELECT ticker, date, {rs(*PX)}, volume, {rs(*FEAT, places=4)}, rn FROM last")
def last_n_bars(spark, sf):
    df = B.last_n(feats(spark, sf))
    return with_rounded(with_rounded(df, *PX), *FEAT, places=4).select("ticker", "date", *PX, "volume", *FEAT, "rn")


LIQUID = "close >= 2 AND dollar_vol_avg_20 >= 50000"


@query(with_("last") + f"SELECT ticker, date, {rs('close', 'ret_21d', 'dollar_vol_avg_20', places=4)} FROM last WHERE rn = 1 AND ret_21d IS NOT NULL AND {LIQUID} ORDER BY last.ret_21d DESC, ticker LIMIT 50")
def liquid_momo_21d(spark, sf):
    df = B.top(B.last_n(feats(spark, sf), 1), F.col("ret_21d"), 50, LIQUID)
    return with_rounded(df, "close", "ret_21d", "dollar_vol_avg_20", places=4).select("ticker", "date", "close", "ret_21d", "dollar_vol_avg_20")


@query(with_("last") + f"SELECT ticker, date, {rs('close', 'ret_21d')} FROM last WHERE rn = 1 AND ret_21d IS NOT NULL ORDER BY last.ret_21d DESC, ticker LIMIT 20")
def top_momentum_21d(spark, sf):
    return with_rounded(B.top(B.last_n(feats(spark, sf), 1), F.col("ret_21d"), 20).select("ticker", "date", "close", "ret_21d"), "close", "ret_21d")


@query(with_("last") + f"SELECT ticker, date, {rs('close', 'range_pct')} FROM last WHERE rn = 1 AND range_pct IS NOT NULL ORDER BY last.range_pct DESC, ticker LIMIT 20")
def range_pct_today(spark, sf):
    return with_rounded(B.top(B.last_n(feats(spark, sf), 1), F.col("range_pct"), 20).select("ticker", "date", "close", "range_pct"), "close", "range_pct")


# ------------------------------------------------------------------ upserts and plans

OLD = "CAST('2000-01-01' AS TIMESTAMP)"
UPD = f"""upd AS (SELECT ticker, date, open, high, low, close * 1.01 AS close, volume, CAST('2000-02-01' AS TIMESTAMP) AS asof_ts FROM bars WHERE date > (SELECT max(date) FROM sess WHERE session_no = (SELECT max(session_no) - 30 FROM sess))),
mrg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY is_new DESC, asof_ts DESC) AS k FROM (SELECT *, {OLD} AS asof_ts, 0 AS is_new FROM bars UNION ALL SELECT *, 1 AS is_new FROM upd)) WHERE k = 1)"""


def update_pair(spark, sf):
    """Bars, and corrected ones of the last 30 sessions."""
    bar = S.bars(spark, sf)
    n = S.sessions(bar)
    cut = n.where(F.col("session_no") == n.agg(F.max("session_no") - 30).scalar()).agg(F.max("date")).scalar()
    old = bar.withColumn("asof_ts", F.lit("2000-01-01").cast("timestamp"))
    new = bar.where(F.col("date") > cut).withColumn("close", F.col("close") * 1.01).withColumn("asof_ts", F.lit("2000-02-01").cast("timestamp"))
    return old, new


@query(with_("bars", "sess", more=UPD) + f"SELECT ticker, date, {rs(*PX)}, volume FROM mrg")
def merge_dedupe(spark, sf):
    return with_rounded(B.merged(*update_pair(spark, sf)).select("ticker", "date", *PX, "volume"), *PX)


@query(with_("bars", "sess", more=UPD) + """SELECT t.ticker, CASE WHEN rows_written IS NULL THEN 'no_data' WHEN n_new IS NULL THEN 'no_change' ELSE 'updated' END AS status, coalesce(rows_written, 0) AS rows_written, last_date
FROM (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT 'NONE') t LEFT JOIN (SELECT ticker, count(*) AS rows_written, max(date) AS last_date FROM mrg GROUP BY 1) m ON m.ticker = t.ticker
LEFT JOIN (SELECT ticker, count(*) AS n_new FROM upd GROUP BY 1) n ON n.ticker = t.ticker""")
def merge_status(spark, sf):
    old, new = update_pair(spark, sf)
    tickers = S.table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    tickers = tickers.unionByName(tickers.limit(1).select(F.lit("NONE").alias("ticker")))
    return B.merge_status(tickers, old, B.merged(old, new), new)


@query(with_("bars") + """SELECT t.ticker, coalesce(last_date + 1, DATE '1990-01-01') AS start, (SELECT max(date) FROM bars) AS "end" FROM (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT 'NONE') t
LEFT JOIN (SELECT ticker, CAST(max(date) AS DATE) AS last_date FROM bars GROUP BY 1) m ON m.ticker = t.ticker WHERE coalesce(last_date + 1, DATE '1990-01-01') <= (SELECT max(date) FROM bars)""")
def incremental_plan(spark, sf):
    bar = S.bars(spark, sf)
    tickers = S.table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    tickers = tickers.unionByName(tickers.limit(1).select(F.lit("NONE").alias("ticker")))
    return B.incremental_plan(tickers, bar, "1990-01-01")


@query(with_("bars", "sess") + """, lastd AS (SELECT date FROM sess ORDER BY date DESC LIMIT 40), have AS (SELECT DISTINCT date FROM bars WHERE day(date) % 3 = 0)
SELECT date, phase, row_number() OVER (ORDER BY phase, date DESC) AS step FROM (SELECT l.date, CASE WHEN l.date = (SELECT max(date) FROM lastd) THEN 0 WHEN h.date IS NULL THEN 1 ELSE 2 END AS phase FROM lastd l LEFT JOIN have h ON h.date = l.date)""")
def ingest_plan(spark, sf):
    bar = S.bars(spark, sf)
    return C.ingest_plan(S.sessions(bar), bar.where(F.dayofmonth("date") % 3 == 0), 40)


@query(with_("bars") + "SELECT date, count(*) AS n_bars, count(DISTINCT ticker) AS n_tickers FROM bars GROUP BY 1")
def partition_inventory(spark, sf):
    return S.bars(spark, sf).groupBy("date").agg(F.count("*").alias("n_bars"), F.countDistinct("ticker").alias("n_tickers"))


@query(with_("bars") + f"SELECT ticker, date, {rs(*PX)}, volume FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def scan_recent_partitions(spark, sf):
    df = S.bars(spark, sf).where("date between date '1995-01-01' and date '1995-12-31'")
    return with_rounded(df.select("ticker", "date", *PX, "volume"), *PX)


def stored_bars(spark, sf):
    """A new folder of stored bars."""
    path = shared_dir(spark) + "/bars"
    S.write_bars(S.bars(spark, sf), path)
    return path


@query(with_("bars") + f"SELECT ticker, date, {rs(*PX)}, volume FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def bars_by_partition(spark, sf):
    """Bars written with one folder a date, and a span of them read again: other folders aren't opened."""
    path = stored_bars(spark, sf)
    return with_rounded(S.read_bars(spark, path, "1995-01-01", "1995-12-31").select("ticker", "date", *PX, "volume"), *PX)


@query(with_("bars") + "SELECT DISTINCT date, 1 AS n_files FROM bars")
def partition_files(spark, sf):
    """Dates of the folders of stored bars, by names alone; a folder of another name is none."""
    return S.partition_inventory(spark, stored_bars(spark, sf)).select("date", "n_files")


@query(with_("bars") + """, a AS (SELECT DISTINCT date FROM bars WHERE day(date) <= 10), b AS (SELECT DISTINCT date FROM bars WHERE day(date) >= 5)
SELECT 'union' AS op, date FROM (SELECT date FROM a UNION SELECT date FROM b) UNION ALL SELECT 'intersect', date FROM (SELECT date FROM a INTERSECT SELECT date FROM b) UNION ALL SELECT 'minus', date FROM (SELECT date FROM a EXCEPT SELECT date FROM b)""")
def date_set_ops(spark, sf):
    d = S.bars(spark, sf).select("date")
    a, b = d.where(F.dayofmonth("date") <= 10), d.where(F.dayofmonth("date") >= 5)
    named = lambda op, df: df.select(F.lit(op).alias("op"), "date")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("minus", a.subtract(b)))


@query(with_("bars", "sess") + """, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, (SELECT max(date) FROM sess WHERE date BETWEEN d - 10 AND d) AS last_session, (SELECT min(date) FROM sess WHERE date BETWEEN d AND d + 10) AS next_session, CAST(d - INTERVAL 24 MONTH AS DATE) AS years_ago FROM d""")
def resolve_session(spark, sf):
    dates = S.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return C.resolve(dates, S.sessions(S.bars(spark, sf)))


@query(with_("plan") + "SELECT sample_id, t, bar_date FROM plan")
def window_plan(spark, sf):
    bar = S.bars(spark, sf)
    return C.planned(S.samples(bar), S.sessions(bar), 20).select("sample_id", (F.col("t_rel") + 19).alias("t"), "bar_date")


# ------------------------------------------------------------------ indicators

IND = """, tr AS (SELECT *, lag(close) OVER w AS pc, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr0 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
tr1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN tr0 END AS tr FROM tr)"""


@query(with_("bars") + IND + f" SELECT ticker, date, {r('tr')} AS true_range FROM tr1", name="true_range")
def true_range_bars(spark, sf):
    w = by("ticker", order="date")
    df = S.bars(spark, sf).withColumn("pc", F.lag("close").over(w))
    return df.select("ticker", "date", rounded(true_range("high", "low", "pc")).alias("true_range"))


def _atr_sql(n):
    f = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(tr) {f} = {n} THEN round(avg(tr) {f}, 6) + 0.0 END AS atr_{n}"


@query(with_("bars") + IND + f" SELECT ticker, date, {_atr_sql(5)}, {_atr_sql(14)}, {_atr_sql(20)} FROM tr1")
def atr_rolling(spark, sf):
    w = by("ticker", order="date")
    df = S.bars(spark, sf).withColumn("pc", F.lag("close").over(w)).withColumn("tr", true_range("high", "low", "pc"))
    return df.select("ticker", "date", *(rounded(full_mean("tr", w, n)).alias(f"atr_{n}") for n in (5, 14, 20)))


@query(with_("bars") + """SELECT ticker, date, CASE WHEN count(volume) OVER f = 20 THEN round(volume / nullif(avg(volume) OVER f, 0), 6) + 0.0 END AS vol_ratio FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def vol_ratio(spark, sf):
    return S.bars(spark, sf).select("ticker", "date", rounded(ratio("volume", full_mean("volume", by("ticker", order="date"), 20))).alias("vol_ratio"))


ARR = """, arr AS (SELECT ticker, list(close ORDER BY date) AS a, list(date ORDER BY date) AS d FROM last GROUP BY 1 HAVING count(*) = 100),
em AS (SELECT ticker, d[i] AS date, a[i] AS close, i, list_reduce(a[1:i], lambda acc, v: (2.0::DOUBLE / 11) * v + (1 - 2.0::DOUBLE / 11) * acc) AS e10, list_reduce(a[1:i], lambda acc, v: (2.0::DOUBLE / 21) * v + (1 - 2.0::DOUBLE / 21) * acc) AS e20 FROM arr, (SELECT unnest(generate_series(1, 100)) AS i) g)"""


def ema_rows(spark, sf):
    """(ticker, t, date, close, ema_10, ema_20) of each ticker's last 100 bars; tickers with fewer go."""
    last = B.last_n(S.bars(spark, sf))
    rows = last.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("b")).where(F.size("b") == 100)
    a = F.col("b.close")
    rows = rows.select("ticker", "b", ema_array(a, 10).alias("e10"), ema_array(a, 20).alias("e20"))
    z = rows.select("ticker", F.posexplode(F.arrays_zip("b", "e10", "e20")).alias("t", "z"))
    return z.select("ticker", "t", "z.b.date", "z.b.close", "z.e10", "z.e20")


@query(with_("last") + ARR + f" SELECT ticker, date, CASE WHEN i >= 10 THEN {r('e10')} END AS ema_10, CASE WHEN i >= 20 THEN {r('e20')} END AS ema_20 FROM em")
def ema(spark, sf):
    df = ema_rows(spark, sf)
    return df.select("ticker", "date", F.when(F.col("t") >= 9, rounded("e10")).alias("ema_10"), F.when(F.col("t") >= 19, rounded("e20")).alias("ema_20"))


@query(with_("last") + ARR + """, sd AS (SELECT *, CASE WHEN count(close) OVER f = 20 THEN stddev_pop(close) OVER f END AS s FROM em WINDOW f AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ticker, date, CASE WHEN i >= 20 THEN round((close - e20) / nullif(s, 0), 6) + 0.0 END AS z20 FROM sd""")
def zscore_ema(spark, sf):
    df = ema_rows(spark, sf)
    w = by("ticker", order="t")
    return df.select("ticker", "date", F.when(F.col("t") >= 19, rounded(ratio(F.col("close") - F.col("e20"), full_std("close", w, 20)))).alias("z20"))


# ------------------------------------------------------------------ listings


@query("""SELECT ticker, name, s_suppkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY s_suppkey) AS k FROM (SELECT upper(trim('  ' || CASE WHEN s_suppkey % 10 = 0 THEN 'na' WHEN s_suppkey % 13 = 0 THEN '' ELSE s_name END || ' ')) AS ticker, s_name AS name, s_suppkey FROM supplier)) WHERE k = 1 AND ticker <> ''""")
def universe_load(spark, sf):
    return U.load(raw_universe(spark, sf))


def raw_universe(spark, sf):
    return S.table(spark, sf, "supplier").select(F.concat(F.lit("  "), F.when(F.col("s_suppkey") % 10 == 0, "na").when(F.col("s_suppkey") % 13 == 0, "").otherwise(F.col("s_name")), F.lit(" ")).alias("ticker"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))


@query(registry.ORACLES["universe_load"])
def universe_csv(spark, sf):
    """Listings written as CSV and read as text: a ticker NA stays one."""
    path = shared_dir(spark) + "/universe.csv"
    R.write_table(raw_universe(spark, sf), path)
    return U.load(L.read_csv(spark, path).withColumn("seq", F.col("seq").cast("long")))


@query("""SELECT s_name AS ticker, CASE substr(c, 1, 1) WHEN 'A' THEN 'AMEX' WHEN 'N' THEN 'NYSE' WHEN 'P' THEN 'NYSEARCA' WHEN 'Z' THEN 'BATS' WHEN 'V' THEN 'IEXG' ELSE 'OTHER' END AS exchange FROM (SELECT s_name, upper(substr('anpzvq', CAST(s_suppkey % 6 + 1 AS INTEGER), 1)) AS c FROM supplier)""")
def universe_normalize(spark, sf):
    return S.table(spark, sf, "supplier").select(F.col("s_name").alias("ticker"), U.exchange_of(F.substring(F.lit("anpzvq"), (F.col("s_suppkey") % 6 + 1).cast("int"), F.lit(1))).alias("exchange"))


@query(with_("univ") + "SELECT ticker, exchange FROM univ WHERE exchange IN ('ASIA', 'EUROPE', 'AMERICA') AND NOT is_etf AND NOT is_test_issue")
def universe_filter(spark, sf):
    return U.filtered(S.universe(spark, sf), ("ASIA", "EUROPE", "AMERICA")).select("ticker", "exchange").orderBy("exchange", "ticker")


@query(with_("univ", more="two AS (SELECT upper(left(ticker, 12)) || (s_suppkey % 40) AS ticker, name, 1 + s_suppkey % 2 AS source_rank, s_suppkey FROM univ)") + "SELECT ticker, name, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY source_rank, name) AS k FROM two) WHERE k = 1")
def universe_dedupe(spark, sf):
    u = S.universe(spark, sf)
    two = u.select(F.concat(F.upper(F.substring("ticker", 1, 12)), (F.col("s_suppkey") % 40).cast("string")).alias("ticker"), "name", (F.col("s_suppkey") % 2 + 1).alias("source_rank"))
    return U.prefer_source(two).select("ticker", "name", "source_rank")


@query("SELECT DISTINCT p_brand AS ticker, replace(lower(replace(p_brand, '#', '-')), '-', '.') || '.us' AS us_lower, upper(replace(replace(p_brand, '#', '.'), '.', '-')) AS dashed FROM part", name="vendor_symbol")
def vendor_symbols(spark, sf):
    t = S.table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return t.select("ticker", vendor_symbol(F.replace("ticker", F.lit("#"), F.lit("-")), "us_lower").alias("us_lower"), vendor_symbol(F.replace("ticker", F.lit("#"), F.lit(".")), "dashed").alias("dashed"))


# ------------------------------------------------------------------ outside formats


@query(with_("bars") + f"SELECT ticker, date, {rs(*PX)}, volume FROM bars")
def bars_from_json(spark, sf):
    """Bars written as grouped-daily JSON texts, and parsed again."""
    bar = S.bars(spark, sf)
    one = F.struct(F.lower("ticker").alias("T"), F.col("open").cast("string").alias("o"), F.col("high").cast("string").alias("h"), F.col("low").cast("string").alias("l"), F.col("close").cast("string").alias("c"), F.col("volume").cast("string").alias("v"))
    texts = bar.groupBy("date").agg(F.to_json(F.struct(F.lit("OK").alias("status"), F.lit(True).alias("adjusted"), F.collect_list(one).alias("results"))).alias("value"))
    return with_rounded(S.bars_from_json(texts).select(F.concat(F.substring("ticker", 1, 1), F.lower(F.expr("substring(ticker, 2)"))).alias("ticker"), "date", *PX, "volume"), *PX)


@query(with_("bars") + f"SELECT upper(ticker) AS ticker, date, {rs(*PX)}, volume FROM bars WHERE date >= DATE '1995-01-01'")
def bars_from_csv(spark, sf):
    """Bars written as vendor answers, one text a ticker with a header, and parsed again."""
    line = F.concat_ws(",", F.col("date").cast("string"), *(F.col(c).cast("string") for c in (*PX, "volume")))
    texts = S.bars(spark, sf).groupBy("ticker").agg(F.concat_ws("\n", F.lit(S.CSV_HEADER), F.array_sort(F.collect_list(line))).alias("value"))
    return with_rounded(S.bars_from_csv(texts, start="1995-01-01").select("ticker", "date", *PX, "volume"), *PX)


CODE = "upper(substr('anpzvq', CAST(s_suppkey % 6 + 1 AS INTEGER), 1))"


@query(with_("univ") + f"""SELECT upper(ticker) AS ticker, name, CASE WHEN s_suppkey % 3 = 0 THEN 'NASDAQ' ELSE CASE {CODE} WHEN 'A' THEN 'AMEX' WHEN 'N' THEN 'NYSE' WHEN 'P' THEN 'NYSEARCA' WHEN 'Z' THEN 'BATS' WHEN 'V' THEN 'IEXG' ELSE 'OTHER' END END AS exchange, is_etf, is_test_issue,
CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS source_rank FROM univ""")
def symdir_parse(spark, sf):
    """Listings written as files of both layouts, one of them with its columns in another order, and parsed again."""
    flag = lambda c: F.when(F.col(c), "Y").otherwise("N")
    code = F.upper(F.substring(F.lit("anpzvq"), (F.col("s_suppkey") % 6 + 1).cast("int"), F.lit(1)))
    first = {"Symbol": "ticker", "Security Name": "name", "Market Category": F.lit("Q"), "Test Issue": flag("is_test_issue"), "Financial Status": F.lit("N"), "Round Lot Size": F.lit("100"), "ETF": flag("is_etf"), "NextShares": F.lit("N")}
    other = {"ACT Symbol": "ticker", "Security Name": "name", "Exchange": code, "CQS Symbol": F.lit("Y"), "ETF": flag("is_etf"), "Round Lot Size": F.lit("100"), "Test Issue": flag("is_test_issue"), "NASDAQ Symbol": F.lit("N")}
    folder = shared_dir(spark) + "/listings"
    u = S.universe(spark, sf)
    for columns, where in ((first, "s_suppkey % 3 = 0"), (other, "s_suppkey % 3 = 1"), (dict(reversed(other.items())), "s_suppkey % 3 = 2")):
        rows = u.where(where).select(F.concat_ws("|", *columns.values()).alias("value"))
        ends = spark.createDataFrame([("|".join(columns),), ("File Creation Time: 0202202521:30|||||||",)], "value string")
        ends.unionByName(rows).coalesce(1).write.mode("append").text(folder)
    return S.read_symbol_directory(spark, folder).drop("file")
