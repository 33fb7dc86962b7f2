"""Hand-computed cases of single operators."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from barwright.functions.rolling import drawdown, ema_array
from barwright.functions.scalars import clean_token, sample_key, ticker_bucket, to_bool, vendor_symbol
from barwright.operators import bars, calendar, labels, metrics, universe, weak, windows
from barwright.operators import window_features as X
from barwright.sources import runs, tables

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


LENGTHS = {"KITE": 112, "LOON": 64, "MINK": 9}


@pytest.fixture(scope="module")
def bar(spark):
    """Closes rise by a half each day from a start of their own."""
    rows = [(t, day(i), 50.0 + i / 2, 51.5 + i / 2, 49.0 + i / 2, 50.5 + i / 2, 700 + i) for t, n in LENGTHS.items() for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume bigint")


def test_last_n(bar):
    rows = bars.last_n(bars.features(bar), 40).collect()
    for t, n in LENGTHS.items():
        own = {r.rn: r.date for r in rows if r.ticker == t}
        assert own == {k: day(n - k) for k in range(1, min(n, 40) + 1)}


def test_last_of_nothing_keeps_the_schema(bar):
    empty = bars.last_n(bars.features(bar.limit(0)))
    assert empty.count() == 0 and {"ret_21d", "rn"} <= set(empty.columns)


def test_returns_count_rows(bar):
    r = bars.features(bar).where("ticker = 'LOON'").orderBy("date").collect()
    assert r[0].ret_1d is None and r[5].ret_5d == pytest.approx(53 / 50.5 - 1) and r[20].ret_21d is None and r[21].ret_21d == pytest.approx(61 / 50.5 - 1)
    assert r[2].vol_avg_20 == 701 and r[63].vol_avg_20 == pytest.approx(753.5) and r[4].range_pct == pytest.approx(2.5 / 52.5)


def test_merge_keeps_the_new_row(spark):
    """New rows win over old ones of their date whatever their times; among themselves the later one does."""
    kind = "ticker string, date date, close double, asof_ts timestamp"
    early, late = dt.datetime(2032, 7, 1, 8), dt.datetime(2032, 7, 1, 19)
    old = spark.createDataFrame([("WREN", day(40), 31.25, late), ("WREN", day(47), 30.5, early), ("TEAL", day(40), 8.75, early)], kind)
    new = spark.createDataFrame([("WREN", day(40), 29.0, early), ("TEAL", day(61), 9.5, early), ("TEAL", day(61), 9.125, late)], kind)
    got = {(r.ticker, r.date): r.close for r in bars.merged(old, new).collect()}
    assert got == {("WREN", day(40)): 29.0, ("WREN", day(47)): 30.5, ("TEAL", day(40)): 8.75, ("TEAL", day(61)): 9.125}


def sessions_of(spark, n):
    return spark.createDataFrame([(day(i), i) for i in range(n)], "date date, session_no int")


def test_mask_at_the_decision_bar(spark, bar):
    samples = spark.createDataFrame([("s", "KITE", day(10), "flag", True)], "sample_id string, ticker string, asof_date date, setup string, label boolean")
    rows = windows.windowed(samples, sessions_of(spark, 150), bar, 3).orderBy("t").collect()
    assert [r.bar_date for r in rows] == [day(8), day(9), day(10)]
    assert rows[2].open == 55.0 and rows[2].high is rows[2].low is rows[2].close is rows[2].volume is None
    assert rows[1].close == 55.0 and rows[0].volume == 708


def test_early_samples_have_no_window(spark, bar):
    samples = spark.createDataFrame([("s", "KITE", day(1), "flag", True)], "sample_id string, ticker string, asof_date date, setup string, label boolean")
    assert windows.windowed(samples, sessions_of(spark, 150), bar, 3).count() == 0


def test_dense_wants_whole_windows(spark, bar):
    samples = spark.createDataFrame([("s", "KITE", day(10), "flag", True)], "sample_id string, ticker string, asof_date date, setup string, label boolean")
    rows = windows.windowed(samples, sessions_of(spark, 150), bar, 3)
    assert len(windows.dense(rows, 3).first().bars) == 3
    with pytest.raises(Exception, match="hasn't 4 rows"):
        windows.dense(rows, 4).collect()


def test_ingest_order(spark):
    """Sessions on every third day; of the newest six, the second and fourth newest are held, as is one that is no session."""
    cal = spark.createDataFrame([(day(3 * i), i) for i in range(14)], "date date, session_no int")
    have = spark.createDataFrame([(day(36),), (day(30),), (day(31),), (day(3),)], "date date")
    plan = calendar.ingest_plan(cal, have, 6).orderBy("step").collect()
    assert [(r.date, r.phase) for r in plan] == [(day(39), 0), (day(33), 1), (day(27), 1), (day(24), 1), (day(36), 2), (day(30), 2)]


def test_ingest_waits_for_the_evening(spark):
    """Until 20:00 in New York today's bars aren't out. In winter that is 01:00 UTC of the next day, in summer midnight."""
    days = [dt.date(2033, 1, 5), dt.date(2035, 1, 4), dt.date(2035, 1, 5), dt.date(2035, 1, 8)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, session_no int")
    last = lambda today, now=None: calendar.last_complete(cal, today, now).first().end
    assert last("2035-01-08") == days[3]
    assert last("2035-01-08", dt.datetime(2035, 1, 9, 0, 59)) == days[2] and last("2035-01-08", dt.datetime(2035, 1, 9, 1, 0)) == days[3]
    assert last("2035-01-07", dt.datetime(2035, 1, 7, 3, 0)) == days[2]  # a Sunday: the Friday is complete at any time
    assert last("2033-01-05", dt.datetime(2033, 1, 5, 15, 0)) == days[0]  # none before it within ten days
    got = calendar.ingest_plan(cal, cal.limit(0), today="2035-01-08", now=dt.datetime(2035, 1, 8, 15, 0), years=2).orderBy("step").collect()
    assert [r.date for r in got] == [days[2], days[1], days[0]]
    assert [r.date for r in calendar.ingest_plan(cal, cal.limit(0), today="2035-01-08", years=1).orderBy("step").collect()] == [days[3], days[2], days[1]]


def test_sessions_of_february_29(spark):
    d = spark.createDataFrame([(dt.date(2024, 2, 29),)], "d date")
    assert calendar.resolve(d, sessions_of(spark, 3), years_back=1).first().years_ago == dt.date(2023, 2, 28)


def test_universe_keeps_na(spark):
    rows = spark.createDataFrame([(" na ", "x", 1), ("NA", "y", 2), ("", "z", 3), (None, "w", 4)], "ticker string, name string, seq int")
    assert [(r.ticker, r.name) for r in universe.load(rows).collect()] == [("NA", "x")]


NASDAQ_HEADER = "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares"
OTHER_HEADER = "ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol"
FIRST = [NASDAQ_HEADER, "wren|Wren Feeds Plc|S|N|D|40|N|N", "ZZQT|Pilot Listing|G|Y|N|100|N|N", "", "MOSS|Moss Index Fund|Q|N|N|100|Y|N", "|No Symbol|Q|N|N|100|N|N", "File Creation Time: 1103203118:02|||||||"]
SECOND = [OTHER_HEADER, "TEAL|Teal Shipping|N|TEAL|N|100|N|TEAL", "MOSS|Moss by Another Name|P|MOSS|N|100|N|MOSS", "KELP|Kelp Bond Fund|Z|KELP|Y|10|N|KELP", "OAT.T|Oat Trial|V|OAT.T|N|100|Y|OAT.T", "FERN|Fern Mines|Q|FERN|N|100|N|FERN|"]


def listed(spark, **files):
    return tables.symbol_directory(spark.createDataFrame([(f, x) for f, lines in files.items() for x in lines], "file string, value string"))


def reordered(lines):
    """The same file with its columns turned round and one more between them."""
    rows = [(x.split("|") + [""] * 8)[:8] for x in lines if x and not x.startswith("File")]
    return ["|".join([*reversed(r[4:]), "Extra" if k == 0 else "Y", *reversed(r[:4])]) for k, r in enumerate(rows)]


def test_symbol_directory(spark):
    """Both layouts: flags stand in columns of different order, only one has exchange codes."""
    want = {
        ("WREN", "NASDAQ", False, False, 0), ("ZZQT", "NASDAQ", False, True, 0), ("MOSS", "NASDAQ", True, False, 0),
        ("TEAL", "NYSE", False, False, 1), ("MOSS", "NYSEARCA", False, False, 1), ("KELP", "BATS", True, False, 1), ("OAT.T", "IEXG", False, True, 1), ("FERN", "OTHER", False, False, 1),
    }
    for a, b in ((FIRST, SECOND), (reordered(FIRST), reordered(SECOND))):
        rows = listed(spark, a=a, b=b)
        assert {(r.ticker, r.exchange, r.is_etf, r.is_test_issue, r.source_rank) for r in rows.collect()} == want
        kept = universe.filtered(universe.prefer_source(rows), ("NASDAQ", "NYSE", "OTHER"))
        assert {(r.ticker, r.name) for r in kept.collect()} == {("WREN", "Wren Feeds Plc"), ("TEAL", "Teal Shipping"), ("FERN", "Fern Mines")}
    assert listed(spark, a=[NASDAQ_HEADER]).count() == 0
    for lines, why in ((FIRST[1:], "no header"), ([NASDAQ_HEADER.replace("ETF", "Fund"), *FIRST[1:]], "is missing"), ([OTHER_HEADER.replace("|Exchange", "|Venue"), *SECOND[1:]], "is missing"), (["Ticker|Security Name|ETF|Test Issue", "A|B|N|N"], "no known layout")):
        with pytest.raises(Exception, match=why):
            listed(spark, a=lines).collect()


def test_vendor_answers(spark):
    head = tables.CSV_HEADER
    answers = [
        ("wren ", f"{head}\r\n2032-07-01,5.5,6.25,5.25,6,1200\r\n2032-07-02,6,6.5,N/A,6.25,\r\nnot a day,1,1,1,1,1\r\n2032-07-05,6,6,6,,50\r\n2032-07-02,6,6.75,5.75,6.5,900\r\n"),
        ("NONE", "No data for this symbol"), ("LEER", "Brak danych"), ("BLANK", " \n"), ("NULL", None), ("BARE", f"\n{head}\n"),
    ]
    df = spark.createDataFrame(answers, "ticker string, value string")
    got = [tuple(r) for r in tables.bars_from_csv(df).orderBy("date").collect()]
    assert got == [("WREN", dt.date(2032, 7, 1), 5.5, 6.25, 5.25, 6.0, 1200), ("WREN", dt.date(2032, 7, 2), 6.0, 6.75, 5.75, 6.5, 900)]
    assert [r.date.day for r in tables.bars_from_csv(df, start="2032-07-02", end="2032-07-02").collect()] == [2]
    for text in ("Date,Close,Open,High,Low,Volume\n2032-07-01,6,5,7,4,1", "<html>Too many requests</html>", "2032-07-01,5,6,4,5,1"):
        with pytest.raises(Exception, match="isn't bars: BAD"):
            tables.bars_from_csv(spark.createDataFrame([("BAD", text)], "ticker string, value string")).collect()


def test_grouped_json(spark):
    """Lower-case and repeated tickers, numbers as text, a missing volume, rows without a close or a ticker."""
    texts = [
        (day(5), '{"status":"OK","adjusted":true,"results":[{"T":"teal","o":"8.5","h":9.25,"l":8.25,"c":9,"v":310.0,"vw":8.8,"n":12},{"T":"wren","o":30,"h":31,"l":29,"c":"30.75"},{"T":"kelp","o":2,"h":2,"l":2,"v":5},{"o":1,"c":1},{"T":"TEAL","o":8.5,"h":9.5,"l":8.25,"c":9.375,"v":"440"}]}'),
        (day(6), '{"status":"OK","results":[]}'), (day(7), "not json"), (day(8), None),
    ]
    got = tables.bars_from_json(spark.createDataFrame(texts, "date date, value string")).orderBy("ticker").collect()
    assert [(r.ticker, r.date, r.open, r.high, r.close, r.volume) for r in got] == [("TEAL", day(5), 8.5, 9.5, 9.375, 440), ("WREN", day(5), 30.0, 31.0, 30.75, 0)]


def test_labels(spark):
    raw = spark.createDataFrame([(" kelp", "2032-11-30", "gap_go", " no ", "7"), ("Moss", "30/11/2032", "flag", "perhaps", "8")], "ticker string, date string, setup string, label string, note string")
    a, b = labels.normalized(raw).orderBy("ticker").collect()
    assert (a.ticker, a.asof_date, a.setup, a.label, a.note) == ("KELP", dt.date(2032, 11, 30), "gap_go", False, "7")
    assert a.sample_id == hashlib.sha1(b"KELP|2032-11-30|gap_go").hexdigest()[:16]
    assert (b.ticker, b.asof_date, b.label, b.sample_id) == ("MOSS", None, None, None)  # without a date there is no id to share
    with pytest.raises(Exception, match="duplicate"):
        labels.deduped(raw.unionByName(raw), ["ticker", "date", "setup"], "label", keep="error").collect()
    with pytest.raises(ValueError, match="missing"):
        labels.normalized(raw.drop("label"))


def test_numbers_as_booleans(spark):
    df = spark.createDataFrame([(1.0, "1.0", 1, True), (0.0, "0", 0, False), (-0.4, "f", 2, None), (2.5, " Y ", None, None), (None, None, 1, True), (float("nan"), "maybe", 0, False)], "a double, b string, c int, d boolean")
    got = [tuple(r) for r in df.select(*(to_bool(c) for c in "abcd")).collect()]
    assert got == [(True, None, True, True), (False, False, False, False), (False, False, None, None), (None, True, None, None), (None, None, True, True), (None, None, False, False)]


RAW_KIND = "ticker string, date string, setup string, label string, fold string, p_label string, split string, is_new string, notes string"


def raw_labels(spark, *rows):
    return spark.createDataFrame([(*r, "3", "0.25", " VAL", "y", "yes") for r in rows], RAW_KIND).coalesce(1)


def test_label_load(spark):
    """Sessions on days 0, 3, 6 ...; day 8 lies between two of them."""
    cal = spark.createDataFrame([(day(3 * i), i) for i in range(9)], "date date, session_no int")
    iso = lambda i: day(i).isoformat()
    raw = raw_labels(spark, (" wren", iso(8), "flag", "T"), ("teal", iso(6), " gap_go ", "no"))
    with pytest.raises(ValueError, match=f"not_a_session: 1 .{iso(8)}"):
        labels.load(raw, cal)
    for resolve, at in (("previous", 6), ("next", 9)):
        got = {r.ticker: r for r in labels.load(raw, cal, resolve=resolve).collect()}
        w = got["WREN"]
        assert (w.asof_date, w.label, w.fold, w.p_label, w.split, w.is_new, w.notes) == (day(at), True, 3, 0.25, "val", True, "yes")
        assert w.sample_id == hashlib.sha1(f"WREN|{iso(at)}|flag".encode()).hexdigest()[:16] and got["TEAL"].setup == "gap_go"
    twice = raw_labels(spark, ("WREN", iso(6), "flag", "1"), ("wren ", iso(8), "flag", "0"), ("WREN", iso(9), "flag", "0"))
    with pytest.raises(ValueError, match="duplicate_key: 1"):
        labels.load(twice, cal, resolve="previous")
    kept = lambda how: {r.asof_date: r.label for r in labels.load(twice, cal, resolve="previous", dedupe=how).collect()}
    assert kept("keep_first") == {day(6): True, day(9): False} and kept("keep_last") == {day(6): False, day(9): False}
    for bad, why in (((" ", iso(6), "flag", "1"), "no_ticker"), (("A", "soon", "flag", "1"), "bad_date"), (("A", iso(6), "", "1"), "no_setup"), (("A", iso(6), "flag", "?"), "bad_label")):
        with pytest.raises(ValueError, match=why):
            labels.load(raw_labels(spark, ("B", iso(3), "flag", "0"), bad), cal)
    with pytest.raises(ValueError, match="no labels"):
        labels.load(raw.limit(0), cal)
    with pytest.raises(ValueError, match="not_a_session"):
        labels.load(raw_labels(spark, ("B", "1999-01-01", "flag", "0")), cal, resolve="next")


def test_time_split(spark):
    rows = spark.createDataFrame([(f"s{i}", "A", day(i), "flag") for i in range(20)], "sample_id string, ticker string, asof_date date, setup string")
    got = [r.split for r in labels.split_time(rows).orderBy("asof_date").collect()]
    assert got == ["train"] * 14 + ["val"] * 3 + ["test"] * 3


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(to_bool(F.lit(" T ")).alias("a"), clean_token(F.lit("__x y/:z-")).alias("b"), ticker_bucket(F.lit("")).alias("c"), vendor_symbol(F.lit(" Oat-T "), "us_lower").alias("d"), vendor_symbol(F.lit("oat.t"), "dashed").alias("e"), sample_key(F.lit("teal"), F.lit("2032-07-01"), F.lit("flag")).alias("f"), sample_key(F.lit("teal"), F.lit(None), F.lit("flag")).alias("g")).first()
    assert tuple(got) == (True, "x_y__z-", "_", "oat.t.us", "OAT-T", hashlib.sha1(b"TEAL|2032-07-01|flag").hexdigest()[:16], None)


def test_folds(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0],)], "a array<double>")
    r = df.select(ema_array("a", 3).alias("k"), ema_array("a", 3, missing="reset").alias("r"), drawdown(F.col("a")).alias("d")).first()
    assert r.k == [1.0, 1.5, 1.5, 2.75] and r.r == [1.0, 1.5, None, 4.0] and r.d == 0.0


def test_tabular_features_by_hand(spark):
    """Four bars and a decision bar. True ranges are 4, 3, 6 from the second bar on, so the last two have a mean of 4.5."""
    kind = "sample_id string, t int, open double, high double, low double, close double, volume double"
    rows = [("s", 0, 20.0, 23.0, 19.0, 20.0, 300.0), ("s", 1, 20.0, 24.0, 20.0, 22.0, 100.0), ("s", 2, 22.0, 23.0, 20.0, 21.0, 200.0), ("s", 3, 21.0, 27.0, 21.0, 25.0, 500.0), ("s", 4, 26.0, None, None, None, None)]
    spec = X.TabularSpec(size=5, horizons=(3,), atr=(1, 2), means=(2,), ema=3, look=1, edge=1, volume=(3,))
    got = X.tabular(spark.createDataFrame(rows, kind), spec).first().asDict()
    want = {
        "gap_pct": 0.04, "gap_direction": 1, "gap_vs_atr": 1 / 4.5, "prev_day_range_pct": 6 / 25, "return_log_3": math.log(26 / 22), "atr_short": 6, "atr_long": 4.5, "atr_short_over_long": 4 / 3,
        "dist_ma2_atr": 3 / 4.5, "dist_ma2_z": 1.5, "range_atr_3": 7 / 4.5, "retrace_pct_3": 1 / 7, "upper_wick_mean_3": 5 / 3, "lower_wick_mean_3": 1 / 3, "body_pct_range_mean_3": 0.5,
        "channel_slope_high_atr_3": 1 / 3, "channel_slope_low_atr_3": 1 / 9, "volume_shock_3": 2.5, "max_drawdown_3": 1 / 22, "ema3_slope_atr": 2 / 4.5, "close_vs_ema3_atr": 2 / 4.5,
    }
    assert {k: got[k] for k in want} == pytest.approx(want) and set(got) - set(want) == {"sample_id", "channel_width_atr_3"}


def test_context_features_by_hand(spark):
    """Highs and lows lie 1 from the close and closes move by at most 1, so every true range is 2; ln(1 + volume) rises by
    0.1 a bar in the last eight."""
    closes = [9, 10, 10, 11, 12, 12, 13, 12, 12, 13, 12]
    volumes = [0.0] * 3 + [math.expm1(0.1 * k) for k in range(1, 9)]
    mean = sum(volumes) / 11
    rows = [("s", t - 11, float(c), c + 1.0, c - 1.0, float(c), v) for t, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    rows += [("s", 0, 12.6, 13.0, 12.2, 12.8, 3 * mean), ("s", 1, 13.0, 15.0, 12.0, 14.0, 1.0), ("s", 2, 13.0, 14.0, 10.0, 11.0, 1.0)]
    ctx = spark.createDataFrame(rows, "sample_id string, t_rel int, open double, high double, low double, close double, volume double")
    got = weak.context_features(ctx).first().asDict()
    want = {"prev_close": 12, "gap_pct": 0.05, "cons_high": 14, "cons_low": 10, "cons_range_pct": 1 / 3, "cons_range_atr": 2, "cons_vol_slope": 0.1, "atr": 2, "impulse_return": 0.2, "past_vol_avg20": mean, "volume_shock": 3, "future_max_close": 14, "future_min_close": 11}
    assert {k: got[k] for k in want} == pytest.approx(want)
    gone = ctx.withColumns({c: F.when(F.col("t_rel") != -10, F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    assert weak.context_features(gone).first().impulse_return is None


def test_pseudo_label_job(spark, bar):
    pool = weak.candidate_pool(bar, ("flag", "gap_go"), "2020-02-10", None, 2.0, 1000.0)
    got = weak.pseudo_labels(pool, sessions_of(spark, 112), bar, setup="gap_go", past=12, future=3, combine="majority", head=30).collect()
    # The newest 30 rows of the pool are KITE's; three of them have no future in the calendar.
    assert len(got) == 27 and {r.ticker for r in got} == {"KITE"} and {r.setup for r in got} == {"gap_go"} and min(r.asof_date for r in got) == day(82)
    assert all((r.p_label, r.weight, r.label, r.label_def_version) == (0.5, 0.0, True, "v1") and len(r.lf_config_hash) == 40 for r in got)
    model = weak.pseudo_labels(pool, sessions_of(spark, 112), bar, setup="flag", past=12, future=3).collect()
    assert len(model) == pool.where("setup = 'flag' and asof_date <= date '2020-04-18'").count() and all(0 <= r.p_label <= 1 for r in model)
    with pytest.raises(ValueError, match="setup"):
        weak.pseudo_labels(pool, sessions_of(spark, 112), bar, setup="other")


def test_nothing_leaks_from_the_decision_bar(spark, bar):
    samples = spark.createDataFrame([("s", "KITE", day(80), "flag", True)], "sample_id string, ticker string, asof_date date, setup string, label boolean")
    poisoned = bar.withColumns({c: F.when(F.col("date") >= F.lit(day(80)), F.lit(1e9)).otherwise(F.col(c)) for c in ("high", "low", "close")})
    poisoned = poisoned.withColumn("open", F.when(F.col("date") > F.lit(day(80)), F.lit(1e9)).otherwise(F.col("open")))
    a, b = (X.tabular(windows.windowed(samples, sessions_of(spark, 150), x, 60)).first() for x in (bar, poisoned))
    assert a == b


def test_auroc_and_auprc(spark):
    p = spark.createDataFrame([("a", "x", 1, 0.9), ("b", "x", 0, 0.9), ("c", "x", 0, 0.1), ("d", "x", 1, 0.5)], "sample_id string, setup string, y_true int, score double")
    assert metrics.auroc(p).first().auroc == pytest.approx((1.5 + 1) / 4)
    assert metrics.auprc(p).first().auprc == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.auroc(p.where("y_true = 1")).first().auroc is None
    assert metrics.at_k(p, (25,)).first().k_eff == 4


def slow_label_model(rows, iterations=50):
    """EM row by row, as the definition reads."""
    m, pi, p, last = len(rows[0]), 0.2, [], None
    acc, cov = [0.7] * m, [sum(r[j] != 0 for r in rows) / len(rows) for j in range(m)]
    for _ in range(iterations):
        p, total = [], 0.0
        for r in rows:
            like = []
            for y, prior in ((1, pi), (-1, 1 - pi)):
                x = prior
                for j, v in enumerate(r):
                    x *= (1 - cov[j]) if v == 0 else cov[j] * (acc[j] if v == y else 1 - acc[j])
                like.append(x)
            p.append(like[0] / sum(like))
            total += math.log(sum(like))
        if last is not None and abs(total - last) < 1e-6:
            break
        last, pi = total, min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
        for j in range(m):
            on = [(v[j], q) for v, q in zip(rows, p, strict=True) if v[j]]
            acc[j] = min(max(sum(q if v == 1 else 1 - q for v, q in on) / len(on), 0.55), 0.95) if on else 0.5
    return p, pi, acc, cov


def test_label_model_against_slow_em(spark):
    import random

    rng = random.Random(11)
    rows = []
    for _ in range(240):
        y = 1 if rng.random() < 0.45 else -1
        rows.append(tuple(0 if rng.random() > c else (y if rng.random() < a else -y) for c, a in ((0.9, 0.9), (0.5, 0.75), (0.7, 0.6))) + (0,))
    names = ["one", "two", "three", "never"]
    out, fit = weak.label_model(spark.createDataFrame([(f"s{i}", *r) for i, r in enumerate(rows)], "sample_id string, one int, two int, three int, never int"), names)
    p, pi, acc, cov = slow_label_model(rows)
    got = {r.sample_id: r for r in out.collect()}
    for i, (r, q) in enumerate(zip(rows, p, strict=True)):
        g = got[f"s{i}"]
        assert g.p_label == pytest.approx(q, abs=1e-6) and g.emitted == sum(v != 0 for v in r) and g.weight == pytest.approx(max(q, 1 - q) if g.emitted else 0, abs=1e-6) and g.label_hard == (g.p_label >= 0.5)
    assert fit["prior"] == pytest.approx(pi, abs=1e-6) and list(fit["accuracy"].values()) == pytest.approx(acc, abs=1e-6) and list(fit["coverage"].values()) == pytest.approx(cov)
    empty, _ = weak.label_model(spark.createDataFrame([], "sample_id string, one int"), ["one"])
    assert empty.count() == 0


def test_bad_votes_fail(spark):
    with pytest.raises(Exception, match="isn't -1, 0 or 1"):
        weak.votes(spark.createDataFrame([("s",)], "sample_id string"), [weak.LabelingFunction("lf", F.lit(2))]).collect()


def test_majority_without_votes(spark):
    r = weak.majority(spark.createDataFrame([("s", 0, 0)], "sample_id string, a int, b int"), ["a", "b"]).first()
    assert (r.p_label, r.label_hard, r.weight) == (0.5, True, 0.0)


def test_flatten_json(spark):
    df = spark.createDataFrame([("f", '{"a":1,"b":{"c":[1,2],"d":{"e":{"f":3}}}}')], "file string, value string")
    got = {r.key: r.val for r in runs.flatten_json(df).collect()}
    assert got == {"a": "1", "b.c": "[1,2]", "b.d.e": '{"f":3}'}


def test_every_event_is_a_run(spark, sf_dir):
    from barwright.plans import research

    ids = {f"run{r.event_id}" for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()}
    got = [r.run for r in research.run_index(spark, sf_dir).collect()]
    assert len(got) == len(ids) and set(got) == ids


def test_ranking_metrics_over_many_ranges(spark):
    import random

    rng = random.Random(4)
    rows = [(f"p{i}", "ab"[i % 2], int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(600)]
    p = spark.createDataFrame(rows, "sample_id string, setup string, y_true int, score double")
    for by, groups in ((None, {None: rows}), ("setup", {s: [r for r in rows if r[1] == s] for s in "ab"})):
        roc, prc = ({r[by] if by else None: r[1 if by else 0] for r in f(p, by).collect()} for f in (metrics.auroc, metrics.auprc))
        for k, own in groups.items():
            pos, neg = [r[3] for r in own if r[2]], [r[3] for r in own if not r[2]]
            assert roc[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
            hits, s = 0, 0.0
            for i, r in enumerate(sorted(own, key=lambda r: (-r[3], r[0])), 1):
                hits += r[2]
                s += r[2] * hits / i
            assert prc[k] == pytest.approx(s / len(pos))
    line = labels.ranked(p, [F.col("score"), F.col("sample_id")]).orderBy("rank").collect()
    assert [r.sample_id for r in line] == [r[0] for r in sorted(rows, key=lambda r: (r[3], r[0]))]


def test_folders_of_bars_are_pruned(spark, bar, tmp_path):
    path = f"file://{tmp_path}/bars"
    tables.write_bars(bar.where("ticker <> 'MINK'").where(F.col("date") < F.lit(day(12))), path)
    bar.limit(1).write.parquet(f"{path}/date=2020-13-77")
    found = tables.partition_inventory(spark, path).orderBy("date").collect()
    assert [r.date for r in found] == [day(i) for i in range(12)] and all(r.n_files == 1 and r.bytes > 0 for r in found)
    span = tables.read_bars(spark, path, "2020-01-03", "2020-01-04")
    plan = span._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date#" in plan and "DataFilters: []" in plan and {r.date for r in span.collect()} == {day(2), day(3)}


def test_store_of_labels(spark, tmp_path):
    raw = spark.createDataFrame([("na", "2024-05-06", "flag", "1"), ("b", "2024-05-07", "flag", "no")], "ticker string, date string, setup string, label string")
    path = f"file://{tmp_path}/labels.parquet"
    labels.write_store(labels.normalized(raw), path, "by hand")
    assert {r.ticker: r.label for r in labels.read_store(spark, path).collect()} == {"NA": True, "B": False}
    side = spark.read.json(f"{path}.meta.json").first()
    assert side.rows == 2 and side.source == "by hand" and side.key_columns == ["ticker", "asof_date", "setup"]
    spark.range(1).write.parquet(f"file://{tmp_path}/other.parquet")
    with pytest.raises(ValueError, match="missing"):
        labels.read_store(spark, f"file://{tmp_path}/other.parquet")


def test_run_files_and_digests(spark, tmp_path):
    import hashlib

    for run, n in (("r1", 3), ("r2", 4)):
        folder = tmp_path / "runs" / "m" / "flag" / run
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text(f'{{"n": {n}, "test": {{"auroc": 0.5}}}}')
        (folder / "notes.txt").write_text("no run file")
    got = {r.run: r.entries for r in runs.read_runs(spark, f"file://{tmp_path}/runs").collect()}
    assert got == {"r1": {"metrics.n": "3", "metrics.test.auroc": "0.5"}, "r2": {"metrics.n": "4", "metrics.test.auroc": "0.5"}}
    found = {r.path.rsplit("/", 2)[1]: r.digest for r in runs.digests(spark, f"file://{tmp_path}/runs", "*.json").collect()}
    assert found["r1"] == hashlib.sha256(b'{"n": 3, "test": {"auroc": 0.5}}').hexdigest() != found["r2"]


def test_queries_in_blocks(spark):
    import numpy as np

    from barwright.operators import embed

    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    asked = items.where("id % 3 = 0")
    pairs = {(r.query, r.id): r.cosine for r in embed.cosine_pairs(items, asked, "id", "v", block=7).collect()}
    assert len(pairs) == 20 * 60 and all(abs(cos[k] - x) < 1e-9 for k, x in pairs.items())
    got = {(r.query, r["rank"]): r.id for r in embed.nearest(items, asked, "id", "v", 3, block=7).collect()}
    want = {(q, k + 1): i for q in range(0, 60, 3) for k, i in enumerate([i for i in np.argsort(-cos[q]) if i != q][:3])}
    assert got == want
