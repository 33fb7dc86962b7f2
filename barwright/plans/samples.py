"""Queries on labels, samples and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import drawdown
from ..functions.scalars import no_nan, rounded
from ..operators import bars as B
from ..operators import labels as L
from ..operators import normalize as N
from ..operators import windows as W
from ..sources import runs as R
from ..sources import tables as S
from ..sources.shared import shared_dir, written
from .market import PX, with_rounded
from .registry import query
from .sql import r, rs, with_

T = 20


def base(spark, sf):
    """Bars, written once since samples, sessions and windows read them each, samples and sessions."""
    bar = written(S.bars(spark, sf))
    return bar, S.samples(bar), S.sessions(bar)


def win(spark, sf, size=T):
    bar, samp, sess = base(spark, sf)
    return W.windowed(samp, sess, bar, size)


# ------------------------------------------------------------------ labels

RAW = """raw AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE ' ' || lower(o_orderpriority) || ' ' END AS ticker, CASE WHEN o_orderkey % 40 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
  o_orderstatus AS setup, CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN ' t ' WHEN 5 THEN 'F' ELSE 'maybe' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE '0' END AS is_gap, o_custkey AS seq, o_orderkey FROM orders),
lab AS (SELECT upper(trim(ticker)) AS ticker, try_cast(date AS DATE) AS asof_date, setup, CASE WHEN lower(trim(label)) IN ('true','t','yes','y','1') THEN true WHEN lower(trim(label)) IN ('false','f','no','n','0') THEN false END AS label, is_gap, seq, o_orderkey FROM raw)"""


def raw_labels(spark, sf):
    o = S.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    words = F.element_at(F.array(*(F.lit(x) for x in ("Yes", "no", "TRUE", "0", " t ", "F", "maybe"))), (k % 7 + 1).cast("int"))
    return o.select(
        F.when(k % 50 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" "))).alias("ticker"),
        F.when(k % 40 == 0, "n/a").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"),
        F.col("o_orderstatus").alias("setup"), words.alias("label"), F.when(k % 2 == 0, "y").otherwise("0").alias("is_gap"), F.col("o_custkey").alias("seq"), "o_orderkey",
    )


@query("WITH " + RAW + " SELECT ticker, asof_date, setup, label, o_orderkey FROM lab")
def labels_normalize(spark, sf):
    return L.normalized(raw_labels(spark, sf)).select("ticker", "asof_date", "setup", "label", "o_orderkey")


@query("SELECT 'is_gap' AS attribute")
def labels_bool_attrs(spark, sf):
    """Columns of the raw labels that hold booleans."""
    raw = raw_labels(spark, sf)
    found = L.boolean_columns(raw, ["setup", "date", "is_gap"])
    return raw.limit(1).select(F.explode(F.array(*(F.lit(c) for c in found))).alias("attribute"))


@query("WITH " + RAW + " SELECT ticker, asof_date, setup, label, o_orderkey FROM lab")
def labels_csv(spark, sf):
    """Labels written as CSV, read as text and normalised."""
    folder = shared_dir(spark)
    R.write_table(raw_labels(spark, sf), f"{folder}/labels.csv")
    return L.normalized(L.read_csv(spark, f"{folder}/labels.csv")).select(F.coalesce("ticker", F.lit("")).alias("ticker"), "asof_date", "setup", "label", F.col("o_orderkey").cast("long").alias("o_orderkey"))


@query("WITH " + RAW + ", one AS (SELECT DISTINCT ticker, asof_date, setup FROM lab) SELECT setup, count(*) AS n, (SELECT count(*) FROM one) AS n_stored FROM one GROUP BY 1")
def labels_store(spark, sf):
    """Labels without duplicates, written as a store and read again, with the number of rows of its sidecar."""
    path = shared_dir(spark) + "/labels.parquet"
    lab = L.normalized(raw_labels(spark, sf))
    L.write_store(L.deduped(lab, ["ticker", "asof_date", "setup"], "o_orderkey"), path, "orders")
    stored = spark.read.schema("source string, rows bigint, columns array<string>, key_columns array<string>").json(f"{path}.meta.json").select(F.col("rows").alias("n_stored"))
    return L.read_store(spark, path).groupBy("setup").agg(F.count("*").alias("n")).crossJoin(F.broadcast(stored))


@query("WITH " + RAW + """, hit AS (SELECT ticker || '|' || coalesce(CAST(asof_date AS VARCHAR), '') || '|' || o_orderkey AS example, unnest(list_filter([CASE WHEN asof_date IS NULL THEN 'bad_date' END, CASE WHEN label IS NULL THEN 'bad_label' END, CASE WHEN ticker = '' THEN 'empty_ticker' END], lambda x: x IS NOT NULL)) AS rule FROM lab)
SELECT rule, n, example, rn FROM (SELECT rule, example, count(*) OVER (PARTITION BY rule) AS n, row_number() OVER (PARTITION BY rule ORDER BY example) AS rn FROM hit) WHERE rn <= 10""")
def dq_violations(spark, sf):
    lab = L.normalized(raw_labels(spark, sf))
    rules = {"bad_date": F.col("asof_date").isNull(), "bad_label": F.col("label").isNull(), "empty_ticker": F.col("ticker") == ""}
    return L.violations(lab, rules, ["ticker", "asof_date", "o_orderkey"])


CLEAN = """clean AS (SELECT ' ' || lower(o_orderpriority) || ' ' AS ticker, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS setup, o_orderkey % 5 IN (0, 2, 4) AS label, o_orderkey % 2 = 0 AS is_gap, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS weight, o_orderkey FROM orders)"""


def clean_labels(spark, sf):
    """Labels as text, all of which can be read."""
    raw = raw_labels(spark, sf).select("setup", "is_gap", "seq", "o_orderkey")
    o = S.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    k = F.col("o_orderkey")
    words = F.element_at(F.array(*(F.lit(x) for x in ("Yes", "no", "TRUE", "0", " t "))), (k % 5 + 1).cast("int"))
    rows = raw.join(o, "o_orderkey")
    return rows.select(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("ticker"), F.col("o_orderdate").cast("date").cast("string").alias("date"), "setup", words.alias("label"), "is_gap", F.when(k % 4 == 0, "n/a").otherwise(F.col("seq").cast("string")).alias("weight"), "o_orderkey")


@query(with_("sess", more=CLEAN + """, lx AS (SELECT upper(trim(ticker)) AS ticker, (SELECT min(date) FROM sess WHERE date BETWEEN d AND d + 10) AS asof_date, setup, label, is_gap, weight, o_orderkey FROM clean)""") + """SELECT substr(sha1(ticker || '|' || CAST(asof_date AS VARCHAR) || '|' || setup), 1, 16) AS sample_id, asof_date, label, is_gap, CAST(weight AS DOUBLE) AS weight FROM lx QUALIFY row_number() OVER (PARTITION BY ticker, asof_date, setup ORDER BY o_orderkey) = 1""")
def labels_load(spark, sf):
    """Labels loaded as one job: dates become the next session, of repeated keys the first row stays."""
    sess = S.sessions(written(S.bars(spark, sf)))
    return L.load(clean_labels(spark, sf), sess, resolve="next", dedupe="keep_first", order="o_orderkey").select("sample_id", "asof_date", "label", "is_gap", "weight")


@query(with_("sess") + "," + RAW + """, hit AS (SELECT 'duplicate_key' AS rule, 1 AS n, ticker || '|' || coalesce(CAST(asof_date AS VARCHAR), '') || '|' || setup AS example FROM lab GROUP BY ticker, asof_date, setup HAVING count(*) > 1
UNION ALL SELECT 'not_a_session', count(*), coalesce(CAST(asof_date AS VARCHAR), '') FROM lab WHERE asof_date IS NULL OR asof_date NOT IN (SELECT date FROM sess) GROUP BY asof_date
UNION ALL SELECT 'wrong_row_count', 1, ticker FROM lab GROUP BY ticker HAVING count(*) <> 100)
SELECT rule, CAST(n AS BIGINT) AS n, example, rn FROM (SELECT rule, example, sum(n) OVER (PARTITION BY rule) AS n, row_number() OVER (PARTITION BY rule ORDER BY example) AS rn FROM hit) WHERE rn <= 10""")
def dq_keyed(spark, sf):
    """Repeated keys, dates that are no sessions, and tickers that haven't a hundred rows."""
    lab = L.normalized(raw_labels(spark, sf))
    return L.keyed_violations(lab, unique=["ticker", "asof_date", "setup"], date="asof_date", sessions=S.sessions(S.bars(spark, sf)), rows_of="ticker", n_rows=100)


def _dedupe_sql(order):
    return "WITH " + RAW + f" SELECT ticker, asof_date, setup, label, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY ticker, asof_date, setup ORDER BY o_orderkey {order}) AS k FROM lab) WHERE k = 1"


@query(_dedupe_sql("ASC"))
def labels_dedupe(spark, sf):
    lab = L.normalized(raw_labels(spark, sf)).select("ticker", "asof_date", "setup", "label", "o_orderkey")
    return L.deduped(lab.withColumn("_k", F.col("o_orderkey")), ["ticker", "asof_date", "setup"], "_k").drop("_k")


@query(_dedupe_sql("DESC"))
def labels_dedupe_last(spark, sf):
    lab = L.normalized(raw_labels(spark, sf)).select("ticker", "asof_date", "setup", "label", "o_orderkey")
    return L.deduped(lab.withColumn("_k", F.col("o_orderkey")), ["ticker", "asof_date", "setup"], "_k", keep="last").drop("_k")


@query(with_("samp") + "SELECT sample_id, ticker, setup FROM samp WHERE setup = 'flag' AND upper(ticker) IN ('BRAND#11', 'BRAND#12', 'BRAND#13')")
def labels_filter(spark, sf):
    return L.filtered(base(spark, sf)[1], "flag", ("brand#11", "Brand#12 ", "BRAND#13")).select("sample_id", "ticker", "setup")


SPLIT = "CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END"


@query(with_("samp") + f"SELECT sample_id, {SPLIT} AS split FROM (SELECT *, row_number() OVER (ORDER BY asof_date, ticker, setup) AS k, count(*) OVER () AS n FROM samp)")
def split_time(spark, sf):
    return L.split_time(base(spark, sf)[1]).select("sample_id", "split")


@query(with_("samp") + f"SELECT sample_id, {SPLIT} AS split FROM (SELECT *, row_number() OVER (ORDER BY sha1('7|' || sample_id), sample_id) AS k, count(*) OVER () AS n FROM samp)")
def split_random(spark, sf):
    return L.split_random(base(spark, sf)[1]).select("sample_id", "split")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM orders")
def split_column(spark, sf):
    k = F.col("o_orderkey")
    words = F.element_at(F.array(*(F.lit(x) for x in (" Train", "VAL ", "test", "other"))), (k % 4 + 1).cast("int"))
    return L.split_column(S.table(spark, sf, "orders").select("o_orderkey", words.alias("given")), "given").select("o_orderkey", "split")


@query(with_("samp") + f"SELECT setup, split, count(*) AS n FROM (SELECT setup, {SPLIT} AS split FROM (SELECT *, row_number() OVER (ORDER BY asof_date, ticker, setup) AS k, count(*) OVER () AS n FROM samp)) GROUP BY 1, 2")
def split_counts(spark, sf):
    return L.split_time(base(spark, sf)[1]).groupBy("setup", "split").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ windows


@query(with_("win") + f"SELECT sample_id, t, bar_date, {rs(*PX)}, volume FROM win")
def windowed_bars(spark, sf):
    return with_rounded(win(spark, sf).select("sample_id", "t", "bar_date", *PX, "volume"), *PX)


@query(with_("plan", "feat") + """SELECT sample_id, t, round(open, 6) + 0.0 AS open, CASE WHEN bar_date <> asof_date THEN round(ret_5d, 6) + 0.0 END AS ret_5d, CASE WHEN bar_date <> asof_date THEN round(vol_avg_20, 4) + 0.0 END AS vol_avg_20
FROM plan p LEFT JOIN feat f ON f.ticker = p.ticker AND f.date = p.bar_date""")
def windowed_bars_feat(spark, sf):
    bar, samp, sess = base(spark, sf)
    rows = W.windowed(samp, sess, B.features(bar), T, ("open", "ret_5d", "vol_avg_20"))
    return with_rounded(with_rounded(rows.select("sample_id", "t", "open", "ret_5d", "vol_avg_20"), "open", "ret_5d"), "vol_avg_20", places=4)


@query(with_("win") + "SELECT sample_id, t, setup, label, ticker, asof_date, length(ticker) AS weight FROM win")
def windowed_meta(spark, sf):
    bar, samp, sess = base(spark, sf)
    rows = W.windowed(samp.withColumn("weight", F.length("ticker")), sess, bar, T)
    return rows.select("sample_id", "t", "setup", "label", "ticker", "asof_date", "weight")


@query(with_("ctx") + f"SELECT sample_id, t_rel, bar_date, label, {rs(*PX)}, volume FROM ctx")
def context_windows(spark, sf):
    bar, samp, sess = base(spark, sf)
    return with_rounded(W.context(samp, sess, bar, 20, 5).select("sample_id", "t_rel", "bar_date", "label", *PX, "volume"), *PX)


@query(with_("win") + "SELECT sample_id, count(*) AS n, count(close) AS valid, round(sum(close * (t + 1)), 4) + 0.0 AS weighted, bool_or(label) AS label FROM win GROUP BY 1")
def sample_arrays(spark, sf):
    """Dense rows, and what their arrays hold."""
    d = W.dense(win(spark, sf), T)
    weighted = F.aggregate(F.filter("bars", lambda b: b["close"].isNotNull()), F.lit(0.0), lambda acc, b: acc + b["close"] * (b["t"] + 1))
    valid = F.size(F.filter("bars", lambda b: b["close"].isNotNull()))
    return d.select("sample_id", F.size("bars").alias("n"), valid.alias("valid"), F.when(valid > 0, rounded(weighted, 4)).alias("weighted"), "label")


@query(with_("win") + f"SELECT sample_id, t, {rs('close')} FROM win WHERE sample_id IN (SELECT sample_id FROM samp WHERE label)")
def windowed_semi(spark, sf):
    """Windows of a list of samples: those with a positive label."""
    ids = base(spark, sf)[1].where("label").select("sample_id")
    return with_rounded(win(spark, sf).join(ids, "sample_id", "left_semi").select("sample_id", "t", "close"), "close")


@query(with_("samp", "plan") + "SELECT sample_id, setup FROM samp WHERE sample_id IN (SELECT sample_id FROM plan)")
def labels_present(spark, sf):
    rows = win(spark, sf).select("sample_id")
    return base(spark, sf)[1].join(rows, "sample_id", "left_semi").select("sample_id", "setup")


@query(with_("win") + "SELECT DISTINCT sample_id FROM win")
def distinct_samples(spark, sf):
    return win(spark, sf).select("sample_id").distinct()


@query(with_("win") + "SELECT count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples, count(DISTINCT ticker) AS n_tickers FROM win")
def build_stats(spark, sf):
    """Counts in two steps: samples first, so that no distinct set meets in one task."""
    per = win(spark, sf).groupBy("sample_id", "ticker").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_samples"), F.countDistinct("ticker").alias("n_tickers"))


@query(with_("win") + "SELECT setup, count(DISTINCT sample_id) AS samples, count(*) AS time_steps, 0.0::DOUBLE AS score FROM win GROUP BY 1")
def warm_counts(spark, sf):
    """What a run of the zero-score baseline has seen."""
    per = win(spark, sf).groupBy("setup", "sample_id").agg(F.count("*").alias("n"))
    return per.groupBy("setup").agg(F.count("*").alias("samples"), F.sum("n").alias("time_steps")).withColumn("score", F.lit(0.0))


def _round(k, of):
    return f"SELECT *, r{k} AS l{k + 1}, xor(l{k}, CAST('0x' || substr(sha1('11|{k}|' || r{k}), 1, 8) AS BIGINT) & (h - 1)) AS r{k + 1} FROM ({of})"


FEISTEL = "SELECT i, n, s, h, i // h AS l0, i % h AS r0 FROM dom, (SELECT unnest(range(0, (SELECT CAST(h * h AS BIGINT) FROM dom))) AS i) x"
for _k in range(4):
    FEISTEL = _round(_k, FEISTEL)
PAIRS = f"""tk AS (SELECT ticker, row_number() OVER (ORDER BY sha1(ticker)) - 1 AS t FROM (SELECT DISTINCT ticker FROM bars)), dom AS (SELECT n, s, CAST(1 << ((length(bin(n - 1)) + 1) // 2) AS BIGINT) AS h FROM (SELECT (SELECT count(*) FROM tk) * (SELECT count(*) FROM sess) AS n, (SELECT count(*) FROM sess) AS s)),
pk AS (SELECT p // s AS t, p % s AS d FROM (SELECT i, n, s, l4 * h + r4 AS p FROM ({FEISTEL})) WHERE p < n ORDER BY i LIMIT 500), pairs AS (SELECT ticker, date FROM pk JOIN tk ON tk.t = pk.t JOIN sess ON session_no = d)"""


@query(with_("bars", "sess", more=PAIRS) + "SELECT ticker, date FROM pairs")
def sample_pairs(spark, sf):
    bar, _, sess = base(spark, sf)
    return W.sampled_pairs(bar, sess, 500, 11)


def _digit_sum(k):
    return f"CAST(sum(CAST('0x' || substr(sha1(ticker || '|' || CAST(date AS VARCHAR)), {k}, 15) AS HUGEINT)) AS VARCHAR)"


@query(with_("bars", "sess", more=PAIRS) + f"SELECT count(*) AS n, sha1(count(*) || '|' || {_digit_sum(1)} || '|' || {_digit_sum(16)}) AS digest FROM pairs")
def sample_fingerprint(spark, sf):
    """The fingerprint that is stored with sampled pairs."""
    bar, _, sess = base(spark, sf)
    path = shared_dir(spark) + "/pairs.parquet"
    W.write_sample(W.sampled_pairs(bar, sess, 500, 11), path)
    return spark.read.schema("n bigint, digest string").json(f"{path}.meta.json")


SLIDE = """idx AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars),
sl AS (SELECT a.ticker, a.date AS start_date, b.date AS end_date, n AS window_size, 50 AS stride, a.i AS start_idx, a.i + n - 1 AS end_idx FROM idx a, (SELECT unnest([16, 32]) AS n) g JOIN idx b ON b.ticker = a.ticker AND b.i = a.i + n - 1 WHERE a.i % 50 = 0),
sid AS (SELECT *, substr(sha1(upper(ticker) || '|' || CAST(start_date AS VARCHAR) || '|' || CAST(end_date AS VARCHAR) || '|L=' || window_size || '|stride=50|i0=' || start_idx || '|i1=' || end_idx), 1, 16) AS window_id FROM sl)"""


@query(with_("bars", more=SLIDE) + "SELECT window_id, ticker, start_date, end_date, window_size, stride, start_idx, end_idx, strftime(end_date, '%Y-%m') AS end_year_month FROM sid")
def sliding_windows(spark, sf):
    return W.sliding(S.bars(spark, sf), (16, 32), 50)


def slide_rows(spark, sf, sizes=(16,), stride=50):
    """Rows of sliding windows: (window_id, pos, values)."""
    bar = S.bars(spark, sf)
    return W.window_rows(bar, W.sliding(bar, sizes, stride))


@query(with_("bars", more=SLIDE) + """SELECT window_id, x.i - start_idx AS pos, round(x.open, 6) + 0.0 AS open, CASE WHEN x.i < end_idx THEN round(x.close, 6) + 0.0 END AS close FROM sid JOIN idx x ON x.ticker = sid.ticker AND x.i BETWEEN start_idx AND end_idx WHERE window_size = 16""")
def sliding_openonly(spark, sf):
    rows = W.open_only_last(slide_rows(spark, sf), "pos", F.col("window_size"))
    return with_rounded(rows.select("window_id", "pos", "open", "close"), "open", "close")


# ------------------------------------------------------------------ normalisation

NC = ("open", "high", "low", "close", "volume")


def _z(c):
    return f"round(({c} - avg({c}) OVER s) / CASE WHEN coalesce(stddev_pop({c}) OVER s, 0) = 0 THEN 1 ELSE stddev_pop({c}) OVER s END, 5) + 0.0 AS {c}"


@query(with_("win") + f"SELECT sample_id, t, {', '.join(map(_z, NC))} FROM win WINDOW s AS (PARTITION BY sample_id)")
def norm_zscore(spark, sf):
    return with_rounded(N.zscore(win(spark, sf)).select("sample_id", "t", *NC), *NC, places=5)


@query(with_("win") + ", m AS (SELECT sample_id, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NC) + " FROM win GROUP BY 1), d AS (SELECT sample_id, " + ", ".join(f"1.4826::DOUBLE * quantile_cont(abs({c} - m_{c}), 0.5) AS d_{c}" for c in NC) + " FROM win JOIN m USING (sample_id) GROUP BY 1) SELECT sample_id, t, " + ", ".join(f"round(({c} - m_{c}) / CASE WHEN coalesce(d_{c}, 0) = 0 THEN 1 ELSE d_{c} END, 5) + 0.0 AS {c}" for c in NC) + " FROM win JOIN m USING (sample_id) JOIN d USING (sample_id)")
def norm_robust(spark, sf):
    return with_rounded(N.robust(win(spark, sf)).select("sample_id", "t", *NC), *NC, places=5)


REL = "rel AS (SELECT sample_id, t, " + ", ".join(f"{c} / nullif(lag(close) OVER s, 0) - 1 AS {c}" for c in PX) + ", ln(1 + volume::DOUBLE) AS volume FROM win WINDOW s AS (PARTITION BY sample_id ORDER BY t))"


@query(with_("win", more=REL) + f"SELECT sample_id, t, {rs(*NC)} FROM rel")
def norm_returns(spark, sf):
    return with_rounded(N.returns_relative(win(spark, sf)).select("sample_id", "t", *NC), *NC)


FIT = "fit AS (SELECT " + ", ".join(f"avg({c}::DOUBLE) AS mean_{c}, sqrt(greatest(avg({c}::DOUBLE * {c}) - avg({c}::DOUBLE) * avg({c}::DOUBLE), 1e-12)) AS std_{c}" for c in NC) + " FROM win)"
FITS = tuple(f"{k}_{c}" for k in ("mean", "std") for c in NC)


@query(with_("win", more=FIT) + f"SELECT {rs(*FITS, places=4)} FROM fit")
def global_zscore_fit(spark, sf):
    return with_rounded(N.fit_global(win(spark, sf)), *FITS, places=4)


def _over_all(c):
    return f"round(({c} - avg({c}::DOUBLE) OVER ()) / sqrt(greatest(avg({c}::DOUBLE * {c}) OVER () - avg({c}::DOUBLE) OVER () * avg({c}::DOUBLE) OVER (), 1e-12)), 4) + 0.0 AS {c}"


@query(with_("win") + f"SELECT sample_id, t, {', '.join(map(_over_all, NC))} FROM win")
def norm_global(spark, sf):
    rows = win(spark, sf)
    return with_rounded(N.apply_global(rows, N.fit_global(rows)).select("sample_id", "t", *NC), *NC, places=4)


@query(with_("win", more=REL) + f"SELECT sample_id, t, {', '.join(map(_z, NC))} FROM rel WINDOW s AS (PARTITION BY sample_id)")
def norm_pipeline(spark, sf):
    return with_rounded(N.zscore(N.returns_relative(win(spark, sf))).select("sample_id", "t", *NC), *NC, places=5)


@query(with_("win") + """, run AS (SELECT sample_id, close, max(close) OVER (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM win WHERE close IS NOT NULL)
SELECT s.sample_id, x AS max_drawdown FROM (SELECT DISTINCT sample_id FROM win) s LEFT JOIN (SELECT sample_id, CASE WHEN count(*) >= 2 THEN round(max(1 - close / peak), 6) + 0.0 END AS x FROM run GROUP BY 1) d ON d.sample_id = s.sample_id""")
def max_drawdown(spark, sf):
    closes = F.transform(F.array_sort(F.collect_list(F.struct("t", no_nan("close").alias("close")))), lambda x: x["close"])
    return win(spark, sf).groupBy("sample_id").agg(closes.alias("c")).select("sample_id", rounded(drawdown(F.col("c"))).alias("max_drawdown"))
