"""Queries on features, candidates, embeddings, models, run tables and the stream."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import bars as B
from ..operators import candidates as C
from ..operators import embed as E
from ..operators import jobs as J
from ..operators import models as M
from ..operators import normalize as N
from ..operators import stages as T
from ..operators import vector_index as V
from ..operators import window_features as X
from ..operators import window_index as I
from ..operators import windows as W
from ..operators.scan import ema_scan
from ..sources import runs as R
from ..sources import tables as S
from ..sources.shared import shared_dir, written
from ..streaming import latest
from ..streaming.upsert import bars_upsert_stream as start_stream
from .market import with_rounded
from .registry import query
from .samples import SLIDE, base, slide_rows, win
from .sql import r, rs, with_

# ------------------------------------------------------------------ features

HS, P, LAST = (5, 10, 20, 40), 59, 58


def _rng(k, hi=LAST):
    return f"FILTER (t BETWEEN {P - k} AND {hi})"


_G = ["max(open) FILTER (t = 59) AS p", *(f"max({c}) FILTER (t = 58) AS {a}" for c, a in (("close", "c1"), ("high", "h1"), ("low", "l1"), ("volume", "v1"))), "avg(tr) FILTER (t BETWEEN 45 AND 58) AS atr_short", "avg(tr) FILTER (t BETWEEN 9 AND 58) AS atr_long"]
for _k in (20, 50):
    _G += [f"avg(close) {_rng(_k)} AS mean{_k}", f"stddev_pop(close) {_rng(_k)} AS std{_k}"]
for _h in HS:
    _ok = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"
    _in = f"t BETWEEN {P - _h} AND 58"
    _G += [f"max(close) FILTER (t = {P - _h}) AS close_{_h}", f"max(high) FILTER ({_in}) AS high_{_h}", f"min(low) FILTER ({_in}) AS low_{_h}"]
    _G += [f"avg(high - greatest(open, close)) FILTER ({_in} AND {_ok}) AS uw_{_h}", f"avg(least(open, close) - low) FILTER ({_in} AND {_ok}) AS lw_{_h}", f"avg(abs(close - open) / greatest(high - low, 1e-12)) FILTER ({_in} AND {_ok}) AS bp_{_h}"]
    _G += [f"avg({c}) FILTER (t BETWEEN 56 AND 58) - avg({c}) FILTER (t BETWEEN {P - _h} AND {P - _h + 2}) AS d{c[0]}_{_h}" for c in ("high", "low")]
    _G += [f"quantile_cont(high, 0.9) FILTER ({_in}) AS q90_{_h}", f"quantile_cont(low, 0.1) FILTER ({_in}) AS q10_{_h}"]
_G += [f"quantile_cont(volume::DOUBLE, 0.5) FILTER (t BETWEEN {P - k} AND 58) AS vmed_{k}" for k in (10, 20)]
_GAP = "CASE WHEN p > 0 AND c1 > 0 THEN p / c1 - 1 END"
_F = {"atr_short": "atr_short", "atr_long": "atr_long", "atr_short_over_long": "atr_short / atrl", "gap_pct": _GAP, "gap_vs_atr": "(p - c1) / atrl", "gap_direction": f"CAST(sign({_GAP}) AS DOUBLE)", "prev_day_range_pct": "(h1 - l1) / nullif(c1, 0)"}
for _k in (20, 50):
    _F |= {f"dist_ma{_k}_atr": f"(p - mean{_k}) / atrl", f"dist_ma{_k}_z": f"(p - mean{_k}) / nullif(std{_k}, 0)"}
for _h in HS:
    _F |= {f"return_log_{_h}": f"CASE WHEN p > 0 AND close_{_h} > 0 THEN ln(p / close_{_h}) END", f"range_atr_{_h}": f"(high_{_h} - low_{_h}) / atrl", f"retrace_pct_{_h}": f"(high_{_h} - p) / greatest(high_{_h} - low_{_h}, 1e-12)"}
    _F |= {f"upper_wick_mean_{_h}": f"uw_{_h}", f"lower_wick_mean_{_h}": f"lw_{_h}", f"body_pct_range_mean_{_h}": f"bp_{_h}"}
    _F |= {f"channel_slope_high_atr_{_h}": f"dh_{_h} / {_h - 1} / atrl", f"channel_slope_low_atr_{_h}": f"dl_{_h} / {_h - 1} / atrl", f"channel_width_atr_{_h}": f"(q90_{_h} - q10_{_h}) / atrl"}
_F |= {"channel_width_contraction_20_over_40": "(q90_20 - q10_20) / nullif(q90_40 - q10_40, 0)", **{f"volume_shock_{k}": f"CASE WHEN vmed_{k} > 0 THEN v1 / vmed_{k} END" for k in (10, 20)}}
TAB = f"""tw AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM win60 WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
tg0 AS (SELECT sample_id, {', '.join(_G)} FROM tw GROUP BY 1), tg AS (SELECT *, CASE WHEN atr_long > 0 THEN atr_long END AS atrl FROM tg0)"""


@query(with_("win60", more=TAB) + "SELECT sample_id, " + ", ".join(f"round({e}, 5) + 0.0 AS {k}" for k, e in _F.items()) + " FROM tg")
def tabular_features(spark, sf):
    """The features that need no fold."""
    df = X.tabular(win(spark, sf, 60), folds=False)
    return with_rounded(df, *[c for c in df.columns if c != "sample_id"], places=5)


_E = "list_reduce({0}, lambda acc, v: CASE WHEN v IS NOT NULL THEN coalesce((2.0::DOUBLE / 21) * v + (1 - 2.0::DOUBLE / 21) * acc, v) END)"
FOLD = f"""fc AS (SELECT sample_id, list(close ORDER BY t) AS c FROM win60 GROUP BY 1), fe AS (SELECT sample_id, {_E.format("c[1:59]")} AS e1, {_E.format("c[1:49]")} AS e2 FROM fc),
""" + ",\n".join(f"dr{h} AS (SELECT sample_id, CASE WHEN count(*) >= 2 THEN max(1 - close / peak) END AS max_drawdown_{h} FROM (SELECT sample_id, close, max(close) OVER (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM win60 WHERE t BETWEEN {P - h} AND 58 AND close IS NOT NULL) GROUP BY 1)" for h in HS)
_FOLDS = {"ema20_slope_atr": "(e1 - e2) / 10 / atrl", "close_vs_ema20_atr": "(c1 - e1) / atrl", **{f"max_drawdown_{h}": f"max_drawdown_{h}" for h in HS}}


@query(with_("win60", more=TAB + ",\n" + FOLD) + "SELECT tg.sample_id, " + ", ".join(f"round({e}, 5) + 0.0 AS {k}" for k, e in (_F | _FOLDS).items()) + " FROM tg JOIN fe ON fe.sample_id = tg.sample_id " + " ".join(f"LEFT JOIN dr{h} ON dr{h}.sample_id = tg.sample_id" for h in HS))
def tabular_features_full(spark, sf):
    """All 56 features."""
    df = X.tabular(win(spark, sf, 60))
    return with_rounded(df, *[c for c in df.columns if c != "sample_id"], places=5)


SH = ("r", "rr", "u", "l", "body", "logv")
LR = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"
TOPC = "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END"
LOWC = "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) END"


S0 = f"s0 AS (SELECT *, lag(close) OVER (PARTITION BY sample_id ORDER BY t) AS pc, {TOPC} AS top, {LOWC} AS bot FROM win)"
SHAPES = f"round({LR('close', 'pc')}, 6) + 0.0 AS r, round({LR('high', 'low')}, 6) + 0.0 AS rr, round({LR('high', 'top')}, 6) + 0.0 AS u, round({LR('bot', 'low')}, 6) + 0.0 AS l, round({LR('top', 'bot')}, 6) + 0.0 AS body, round(ln(1 + volume::DOUBLE), 6) + 0.0 AS logv"
_K = "list_reduce({0}[1:t + 1], lambda acc, v: coalesce((2.0::DOUBLE / 21) * v + (1 - 2.0::DOUBLE / 21) * acc, acc, v))"
S1 = f"""s1 AS (SELECT *, CASE WHEN high >= low THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM s0),
sl AS (SELECT sample_id, list(close ORDER BY t) AS cs, list(tr ORDER BY t) AS ts FROM s1 GROUP BY 1),
s2 AS (SELECT s1.*, {_K.format("cs")} AS e, {_K.format("ts")} AS a FROM s1 JOIN sl ON sl.sample_id = s1.sample_id)"""


@query(with_("win", more=S0) + f"SELECT sample_id, t, {SHAPES} FROM s0")
def shape_features(spark, sf):
    return with_rounded(X.shape(win(spark, sf), pos=False).select("sample_id", "t", *SH), *SH)


@query(with_("win", more=S0 + ",\n" + S1) + f"SELECT sample_id, t, {SHAPES}, round(CASE WHEN a > 0 THEN (close - e) / a END, 6) + 0.0 AS pos FROM s2")
def shape_features_pos(spark, sf):
    """With the place over the mean in units of ATR."""
    return with_rounded(X.shape(win(spark, sf)).select("sample_id", "t", *SH, "pos"), *SH, "pos")


IMP = ("gap_pct", "atr_short", "return_log_20")


@query(with_("win60", more=TAB + ", ft AS (SELECT sample_id, " + ", ".join(f"{_F[c]} AS {c}" for c in IMP) + " FROM tg)") + "SELECT " + ", ".join(f"round(coalesce(quantile_cont({c}, 0.5), 0), 6) + 0.0 AS {c}" for c in IMP) + " FROM ft")
def impute_fit(spark, sf):
    return with_rounded(X.impute_fit(X.tabular(win(spark, sf, 60), folds=False), list(IMP)), *IMP)


@query(with_("win60", more=TAB + ", ft AS (SELECT sample_id, " + ", ".join(f"{_F[c]} AS {c}" for c in IMP) + " FROM tg), md AS (SELECT " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS m_{c}" for c in IMP) + " FROM ft)") + "SELECT sample_id, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) + 0.0 AS {c}" for c in IMP) + " FROM ft CROSS JOIN md")
def impute_apply(spark, sf):
    df = X.tabular(win(spark, sf, 60), folds=False).select("sample_id", *IMP)
    return with_rounded(X.impute(df, X.impute_fit(df, list(IMP)), list(IMP)), *IMP)


PC = ("open", "close", "volume")
ST = [f"{c}_{s}" for c in PC for s in ("mean", "std", "min", "max", "last", "slope")]


def _pool(c):
    x = f"{c}::DOUBLE"
    return f"avg({x}) AS {c}_mean, stddev_pop({x}) AS {c}_std, min({x}) AS {c}_min, max({x}) AS {c}_max, arg_max({x}, t) FILTER ({c} IS NOT NULL) AS {c}_last, regr_slope({x}, t::DOUBLE) AS {c}_slope"


@query(with_("win", more=f"ps AS (SELECT sample_id, {', '.join(map(_pool, PC))} FROM win GROUP BY 1)") + f"SELECT sample_id, {rs(*ST, places=7)} FROM ps")
def pooled_stats_embed(spark, sf):
    """The statistics of the pooled embedding."""
    return with_rounded(X.pooled(win(spark, sf), PC), *ST, places=7)


FIVE = ("open", "high", "low", "close", "volume")


@query(with_("win") + "SELECT sample_id, 128 AS dims, CASE WHEN max(open) > min(open) OR max(high) > min(high) OR max(low) > min(low) OR max(close) > min(close) OR max(volume) > min(volume) THEN 1.0 ELSE 0.0 END AS length FROM win GROUP BY 1")
def pooled_embedding(spark, sf):
    """The whole pooled embedding of five columns (30 statistics and 160 places of curves, projected to 128 dimensions), of
    length 1; 0 for a window in which nothing varies. Its values are held against numpy in a test."""
    return J.embedded_windows(win(spark, sf)).select("sample_id", F.size("embedding").alias("dims"), rounded(E.dot("embedding", "embedding"), 4).alias("length"))


@query(with_("win") + "SELECT sample_id, round(avg(open), 6) + 0.0 AS e0, round(avg(close), 6) + 0.0 AS e1, round(avg(volume), 6) + 0.0 AS e2, bool_or(open IS NOT NULL) AS any_bar FROM win GROUP BY 1")
def masked_mean_embed(spark, sf):
    """Mean of the valid rows of each feature, and whether any row is valid."""
    g = win(spark, sf).groupBy("sample_id").agg(F.avg("open").alias("e0"), F.avg("close").alias("e1"), F.avg("volume").alias("e2"), F.bool_or(F.col("open").isNotNull()).alias("any_bar"))
    return with_rounded(g, "e0", "e1", "e2")


@query()
def augment_windows(spark, sf):
    """Cropped, jittered, thinned, censored and masked variants of windows."""
    out = X.augment(win(spark, sf), PC, crops=(12, 16), sigma=0.05, drop=0.1, censor=0.5, modes=("both",))
    return with_rounded(out.select("sample_id", "t", "crop", *PC, *(f"masked_{c}" for c in PC)), *PC)


# ------------------------------------------------------------------ candidates

CIND = """c0 AS (SELECT ticker, date, open, high, low, close, volume, 100 - rn AS t, max(date) OVER (PARTITION BY ticker) AS asof_date FROM last QUALIFY count(*) OVER (PARTITION BY ticker) = 100),
ca AS (SELECT ticker, list(close ORDER BY t) AS a FROM c0 GROUP BY 1),
ce AS (SELECT ticker, i - 1 AS t, list_reduce(a[1:i], lambda acc, v: (2.0::DOUBLE / 11) * v + (1 - 2.0::DOUBLE / 11) * acc) AS e10, list_reduce(a[1:i], lambda acc, v: (2.0::DOUBLE / 21) * v + (1 - 2.0::DOUBLE / 21) * acc) AS e20 FROM ca, (SELECT unnest(generate_series(1, 100)) AS i) g),
c1 AS (SELECT c0.*, CASE WHEN c0.t >= 9 THEN e10 END AS ma10, CASE WHEN c0.t >= 19 THEN e20 END AS ma20, lag(close) OVER w AS prev FROM c0 JOIN ce ON ce.ticker = c0.ticker AND ce.t = c0.t WINDOW w AS (PARTITION BY c0.ticker ORDER BY c0.t)),
c2 AS (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM c1),
ci AS (SELECT *, 99 - t AS eo, CASE WHEN count(tr) OVER (w ROWS 13 PRECEDING) = 14 THEN avg(tr) OVER (w ROWS 13 PRECEDING) END AS atr14, CASE WHEN count(tr) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(tr) OVER (w ROWS 4 PRECEDING) / nullif(avg(tr) OVER (w ROWS 19 PRECEDING), 0) END AS ar, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN volume / nullif(avg(volume) OVER (w ROWS 19 PRECEDING), 0) END AS vr,
  CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS sd20, CASE WHEN count(*) OVER (w ROWS 49 PRECEDING) = 50 THEN stddev_pop(close) OVER (w ROWS 49 PRECEDING) END AS sd50 FROM c2 WINDOW w AS (PARTITION BY ticker ORDER BY t))"""
CKEY = "false AS label, t - L + 1 AS cand_t_start, t AS cand_t_end, L AS cand_length, eo AS cand_end_offset"
CCOLS = ("ticker", "asof_date", "setup", "label", "cand_t_start", "cand_t_end", "cand_length", "cand_end_offset")


def ind(spark, sf):
    return C.indicators(B.last_n(S.bars(spark, sf)))


GAP_SQL = f"SELECT ticker, asof_date, 'gap:gap_event:L' || L || ':E' || eo || '_gap' || CAST(round(g * 100) AS INTEGER) || '_vol' || v || CASE WHEN open > prev THEN '_dirup' ELSE '_dirdn' END AS setup, {CKEY}, round(gap, 6) + 0.0 AS cand_gap_pct, round(vr, 6) + 0.0 AS cand_vol_ratio, CAST(open > prev AS INTEGER) AS cand_dir_up FROM (SELECT *, abs(open - prev) / prev AS gap FROM ci WHERE eo < 7 AND prev <> 0), (SELECT unnest([0.02, 0.04, 0.06]) AS g) a, (SELECT unnest([2, 3, 5]) AS v) b, (SELECT unnest([8, 16, 32, 64]) AS L) c WHERE gap >= g AND vr >= v AND t - L + 1 >= 0"
MR_SQL = f"SELECT ticker, asof_date, 'meanrev:zscore_extreme:L' || L || ':E' || eo || '_z' || CASE lim WHEN 1.5 THEN '1.5' WHEN 2 THEN '2' ELSE '3' END || '_w' || w AS setup, {CKEY}, round(z, 6) + 0.0 AS cand_z, w AS cand_z_window FROM (SELECT *, (close - ma20) / CASE WHEN w = 20 THEN sd20 ELSE sd50 END AS z FROM ci, (SELECT unnest([20, 50]) AS w) a WHERE eo < 7 AND t >= w AND CASE WHEN w = 20 THEN sd20 ELSE sd50 END > 0), (SELECT unnest([1.5, 2, 3]) AS lim) b, (SELECT unnest([16, 32, 64]) AS L) c WHERE abs(z) >= lim AND t - L + 1 >= 0"
PIVOT_SQL = f"""SELECT e.ticker, e.asof_date, 'pivot:shakeout_reclaim:L' || L || ':E' || e.eo || '_pb' || pb AS setup, false AS label, e.t - L + 1 AS cand_t_start, e.t AS cand_t_end, L AS cand_length, e.eo AS cand_end_offset, pb AS cand_pullback_len, round(e.prev / nullif(x.close, 0) - 1, 6) + 0.0 AS cand_pullback_ret,
round((SELECT min(low) FROM ci l WHERE l.ticker = e.ticker AND l.t BETWEEN e.t - pb AND e.t - 1), 6) + 0.0 AS cand_pull_low, round(CASE WHEN q.atr14 > 0 THEN (q.ma10 - e.prev) / q.atr14 END, 6) + 0.0 AS cand_depth_atr
FROM ci e, (SELECT unnest([1, 2, 3, 4]) AS pb) a, (SELECT unnest([8, 16, 24, 32]) AS L) c JOIN ci x ON x.ticker = e.ticker AND x.t = e.t - pb - 1 JOIN ci q ON q.ticker = e.ticker AND q.t = e.t - 1 WHERE e.eo < 7 AND e.t >= 5 AND e.t - pb >= 1 AND x.close > x.ma20 AND e.close > e.ma10 AND e.close > e.prev AND e.t - L + 1 >= 0"""
CFLAG = """f0 AS (SELECT e.ticker, e.asof_date, e.t, e.eo, L, e.t - L + 1 AS s, e.close / z.close - 1 AS total, e.t - L + 1 + CAST(floor(0.66::DOUBLE * (L - 1)) AS INTEGER) AS stop FROM ci e, (SELECT unnest([10, 20, 30, 40, 60]) AS L) g JOIN ci z ON z.ticker = e.ticker AND z.t = e.t - L + 1 WHERE e.eo < 7 AND e.t - L + 1 >= 0 AND z.close <> 0),
f1 AS (SELECT f0.*, i.t AS i, i.close AS ci0, j.close AS cj, j.close / i.close - 1 AS ret FROM f0 JOIN ci i ON i.ticker = f0.ticker AND i.t BETWEEN s AND greatest(s, stop - 4) JOIN ci j ON j.ticker = i.ticker AND j.t = i.t + 4 WHERE i.close <> 0 QUALIFY row_number() OVER (PARTITION BY f0.ticker, f0.t, L ORDER BY j.close / i.close - 1 DESC, i.t) = 1),
f2 AS (SELECT f1.*, (SELECT avg(ar) FROM ci a WHERE a.ticker = f1.ticker AND a.t BETWEEN f1.i AND f1.i + 4) AS imp, (SELECT avg(ar) FROM ci a WHERE a.ticker = f1.ticker AND a.t BETWEEN f1.i + 5 AND f1.t) AS con, (SELECT min(close) FROM ci a WHERE a.ticker = f1.ticker AND a.t BETWEEN f1.i + 4 AND f1.t) AS low0 FROM f1),
f3 AS (SELECT *, (cj - low0) / nullif(cj - ci0, 0) AS retrace FROM f2)"""
FLAG_SQL = "SELECT ticker, asof_date, 'flag:impulse_consolidation:L' || L || ':E' || eo || '_k5_imp' || printf('%.2f', ret) || '_atrexp' || coalesce(printf('%.2f', imp), 'nan') || '_atrcon' || printf('%.2f', con) AS setup, false AS label, s AS cand_t_start, t AS cand_t_end, L AS cand_length, eo AS cand_end_offset, round(total, 6) + 0.0 AS cand_total_ret, round(ret, 6) + 0.0 AS cand_impulse_ret, 5 AS cand_impulse_k, round(imp, 6) + 0.0 AS cand_impulse_atr_ratio, round(con, 6) + 0.0 AS cand_consolidation_atr_ratio, round(retrace, 6) + 0.0 AS cand_retrace FROM f3 WHERE ret >= 0.05 AND con <= 1.0 AND retrace <= 0.8"
GAP_COLS, MR_COLS, PIVOT_COLS = ("cand_gap_pct", "cand_vol_ratio"), ("cand_z",), ("cand_pullback_ret", "cand_pull_low", "cand_depth_atr")
FLAG_COLS = ("cand_total_ret", "cand_impulse_ret", "cand_impulse_atr_ratio", "cand_consolidation_atr_ratio", "cand_retrace")
EVERY_SQL = " UNION ALL BY NAME ".join(f"({x})" for x in (GAP_SQL, MR_SQL, PIVOT_SQL, FLAG_SQL))


@query(with_("last", more=CIND) + GAP_SQL)
def cand_gap(spark, sf):
    return with_rounded(C.gap(ind(spark, sf)), *GAP_COLS)


@query(with_("last", more=CIND) + MR_SQL)
def cand_meanrev(spark, sf):
    return with_rounded(C.meanrev(ind(spark, sf)), *MR_COLS)


@query(with_("last", more=CIND) + PIVOT_SQL)
def cand_pivot(spark, sf):
    return with_rounded(C.pivot(ind(spark, sf)), *PIVOT_COLS)


@query(with_("last", more=CIND + ",\n" + CFLAG) + FLAG_SQL)
def cand_flag(spark, sf):
    return with_rounded(C.flag(ind(spark, sf)), *FLAG_COLS)


@query(with_("last", more=CIND + ",\n" + CFLAG) + EVERY_SQL)
def candidates_all(spark, sf):
    return with_rounded(C.every(B.last_n(S.bars(spark, sf))), *GAP_COLS, *MR_COLS, *PIVOT_COLS, *FLAG_COLS)


META = ("cand_length", "cand_end_offset", "cand_gap_pct", "cand_vol_ratio", "cand_z", "cand_depth_atr", "cand_retrace")


@query(with_("last", more=CIND + ",\n" + CFLAG) + "SELECT ticker, setup, " + ", ".join(f"coalesce({c}::DOUBLE, 0) AS m{i}" for i, c in enumerate(META)) + f" FROM ({EVERY_SQL})")
def cand_meta_vec(spark, sf):
    """Numeric columns of candidates as a vector, missing values as 0; its places as columns."""
    df = C.every(B.last_n(S.bars(spark, sf)))
    df = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in META})
    vec = VectorAssembler(inputCols=list(META), outputCol="v").transform(df).select("ticker", "setup", vector_to_array("v").alias("meta"))
    return vec.select("ticker", "setup", *(rounded(F.get("meta", F.lit(i))).alias(f"m{i}") for i in range(len(META))))


# ------------------------------------------------------------------ embeddings

NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
VEC = f"ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest({NORM}, 1e-12)) AS v FROM embeddings), cp AS (SELECT q.vec_id AS query, i.vec_id, list_dot_product(q.v, i.v) AS cosine FROM ev q, ev i WHERE q.vec_id % 100 = 0)"


@query("WITH " + VEC + " SELECT query, vec_id, round(cosine, 5) + 0.0 AS cosine FROM cp")
def cosine_pairs(spark, sf):
    """Every hundredth id as a query, so that queries grow with the table, against all rows."""
    e = S.table(spark, sf, "embeddings")
    return E.cosine_pairs(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding").withColumn("cosine", E.rounded_cosine("cosine", 5))


@query("WITH " + VEC + " SELECT query, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM cp WHERE query <> vec_id) WHERE rank <= 10")
def knn_cosine(spark, sf):
    e = S.table(spark, sf, "embeddings")
    return E.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "vec_id", "rank")


GRID = ((16, 32), (25, 50))


def index_rows(spark, sf, sizes=GRID[0], strides=GRID[1]):
    """Embedded windows of every length and stride of the grid."""
    parts = []
    for stride in strides:
        rows = slide_rows(spark, sf, sizes, stride).withColumnRenamed("window_id", "sample_id").withColumnRenamed("pos", "t")
        rows = N.zscore(N.returns_relative(rows).select("sample_id", "t", *PC), PC)
        parts.append(W.sliding(S.bars(spark, sf), sizes, stride).join(E.window_embeddings(rows, "sample_id", "t", PC, dims=256).withColumnRenamed("sample_id", "window_id"), "window_id"))
    return reduce(DataFrame.unionByName, parts)


def stored_index(spark, sf):
    path = shared_dir(spark) + "/index"
    E.write_index(index_rows(spark, sf), path)
    return E.read_index(spark, path)


SLIDES = ",\n".join(SLIDE.replace("idx AS", f"idx{k} AS").replace("FROM idx a", f"FROM idx{k} a").replace("JOIN idx b", f"JOIN idx{k} b").replace("50 AS stride", f"{k} AS stride").replace("a.i % 50", f"a.i % {k}").replace("stride=50", f"stride={k}").replace("sl AS", f"sl{k} AS").replace("FROM sl)", f"FROM sl{k})").replace("sid AS", f"sid{k} AS") for k in GRID[1])
EVERY_WINDOW = " UNION ALL ".join(f"SELECT * FROM sid{k}" for k in GRID[1])


# The first place of an embedding is the mean of the first column over the length of the whole vector; ratios of statistics
# don't depend on that length, so they show that each window got its own values.
def _stats_sql(k):
    x = f"""SELECT s.window_id, s.ticker, s.end_date, strftime(s.end_date, '%Y-%m') AS end_year_month, s.window_size, s.stride, i.i - start_idx AS t, open, close, ln(1 + volume::DOUBLE) AS v, lag(close) OVER (PARTITION BY s.window_id ORDER BY i.i) AS pc FROM sid{k} s JOIN idx{k} i ON i.ticker = s.ticker AND i.i BETWEEN start_idx AND end_idx"""
    return f"""SELECT window_id, ticker, end_date, end_year_month, window_size, stride, round(max(zo) / nullif(max(zc), 0), 3) + 0.0 AS max_open_over_close, round(min(zo) / nullif(max(zv), 0), 3) + 0.0 AS min_open_over_volume FROM (SELECT *, (ro - avg(ro) OVER w) / CASE WHEN coalesce(stddev_pop(ro) OVER w, 0) = 0 THEN 1 ELSE stddev_pop(ro) OVER w END AS zo,
(rc - avg(rc) OVER w) / CASE WHEN coalesce(stddev_pop(rc) OVER w, 0) = 0 THEN 1 ELSE stddev_pop(rc) OVER w END AS zc, (v - avg(v) OVER w) / CASE WHEN coalesce(stddev_pop(v) OVER w, 0) = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS zv
FROM (SELECT *, open / nullif(pc, 0) - 1 AS ro, close / nullif(pc, 0) - 1 AS rc FROM ({x})) WINDOW w AS (PARTITION BY window_id)) GROUP BY ALL"""


INDEX_STATS = " UNION ALL ".join(f"({_stats_sql(k)})" for k in GRID[1])
MAX_OPEN, MIN_OPEN, MAX_CLOSE, MAX_VOLUME = 3, 2, 9, 15  # places of statistics: 6 of a column, in the order of STATISTICS


def index_values():
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    share = lambda a, b: rounded(F.when(F.abs(at(b)) > 1e-12, at(a) / at(b)), 3)
    return share(MAX_OPEN, MAX_CLOSE).alias("max_open_over_close"), share(MIN_OPEN, MAX_VOLUME).alias("min_open_over_volume")


@query(with_("bars", more=SLIDES) + f"SELECT window_id, ticker, end_year_month, window_size, stride, max_open_over_close, min_open_over_volume FROM ({INDEX_STATS})")
def embed_index(spark, sf):
    """The index of embedded windows over the grid of lengths and strides, written in folders by length, ticker bucket and
    month of the end, and read again."""
    return stored_index(spark, sf).select("window_id", "ticker", "end_year_month", "window_size", "stride", *index_values())


@query(with_("bars", more=SLIDES) + f"SELECT window_id, ticker, end_date, max_open_over_close, min_open_over_volume FROM ({INDEX_STATS}) WHERE window_size = 16 AND stride = 50")
def embed_lookup(spark, sf):
    """Stored index rows of example windows: those of the first length and the last stride, found by their keys."""
    examples = W.sliding(S.bars(spark, sf), (16,), 50).select("ticker", "end_date", "window_size", "stride", "start_idx", "end_year_month")
    return E.lookup(stored_index(spark, sf), examples).select("window_id", "ticker", "end_date", *index_values())


def updated_index(spark, sf, sizes=GRID[0], strides=GRID[1]):
    """The folder of an index that was made of bars before 1997 and brought up to date with all of them."""
    path, bar = shared_dir(spark) + "/kept", written(S.bars(spark, sf))
    for rows in (bar.where("date < date '1997-01-01'"), bar):
        I.update_index(spark, path, rows, sizes, strides, I.Encoder(columns=PC, dims=256))
    return path


@query(with_("bars", more=SLIDES) + f"SELECT window_id, ticker, end_year_month, window_size, stride, max_open_over_close, min_open_over_volume FROM ({INDEX_STATS})")
def index_updated(spark, sf):
    """The index in two drops, of which the second embeds new windows only: the rows of an index made at once."""
    return I.open_index(spark, updated_index(spark, sf)).select("window_id", "ticker", "end_year_month", "window_size", "stride", *index_values())


@query(with_("bars", more=SLIDES) + f"SELECT ticker, window_size, stride, max(end_date) AS last_date, count(*) AS n_windows FROM sid50 WHERE window_size = 32 GROUP BY ALL")
def index_manifest(spark, sf):
    """What an index of one length and stride knows of itself: the newest window of each ticker."""
    return I.manifest(spark, updated_index(spark, sf, (32,), (50,)))


@query()
def knn_index(spark, sf):
    """The ten nearest rows of every hundredth id, found in a few cells of a stored index: as many as hold 97 % of the
    neighbours of a sample of other rows (ids that leave 10 when divided by 20; 10,000 of them at most)."""
    e = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = V.build_index(e, shared_dir(spark) + "/vectors", "vec_id", "embedding")
    probes = V.probes_for(index, e.where("vec_id % 20 = 10"), 10, 0.97)
    return V.search(index, e.where("vec_id % 100 = 0"), 10, probes=probes).select("query", "vec_id", "rank")


@query("SELECT count(*) AS n_queries, TRUE AS found_nine_tenths FROM embeddings WHERE vec_id % 100 = 0")
def knn_index_recall(spark, sf):
    """Whether the index found at least nine tenths of the exact ten nearest rows of every hundredth id."""
    e = S.table(spark, sf, "embeddings")
    found = written(knn_index(spark, sf))
    share = V.recall(found, E.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10), "vec_id")
    return e.where("vec_id % 100 = 0").agg(F.count("*").alias("n_queries")).withColumn("found_nine_tenths", F.lit(share >= 0.9))


# ------------------------------------------------------------------ models

REFITS = tuple(f"{y}-01-01" for y in range(1993, 1999))  # the regime model is fitted anew each year on all bars before


def regime_rows(bar):
    return M.regimes(bar, cutoffs=list(REFITS))


def training(spark, sf):
    """All 57 features with labels, split by time: the last fifth tests, the fifth before validates."""
    bar, samp, sess = base(spark, sf)
    return J.training_table(samp, sess, bar, regime=regime_rows(bar))


def _trained(spark, sf, kind):
    rows, names = training(spark, sf)
    return rows, T.train(rows, names, kind=kind)


@query()
def features_57(spark, sf):
    """All features of each sample: 56 of its window, and the regime probability of the bar before."""
    bar, samp, sess = base(spark, sf)
    rows, names = J.feature_table(samp, sess, bar, regime=regime_rows(bar))
    return with_rounded(rows, *names)


@query()
def logreg_scores(spark, sf):
    """Calibrated logistic regression on all features."""
    rows, model = _trained(spark, sf, "logistic")
    return with_rounded(T.scored(model, rows, ["sample_id", "split", "y"]), "score", "calibrated", places=4)


@query()
def gbt_scores(spark, sf):
    """Calibrated boosted trees on all features."""
    rows, model = _trained(spark, sf, "boosted")
    return with_rounded(T.scored(model, rows, ["sample_id", "split", "y"]), "score", "calibrated", places=4)


@query()
def scan_model(spark, sf):
    """Every ticker at the latest session, scored by a model that was trained, stored and read again, the highest first."""
    bar, samp, sess = base(spark, sf)
    regime = regime_rows(bar)
    rows, names = J.training_table(samp, sess, bar, regime=regime)
    path = shared_dir(spark) + "/model"
    T.train(rows, names).write().save(path)
    return with_rounded(J.scan(bar.select("ticker"), sess, bar, T.load(path), regime=regime), "score", "calibrated", places=4)


FIT_ROWS = "pmod(xxhash64(sample_id), 2) = 0"


@query()
def calibrate_platt(spark, sf):
    return with_rounded(M.platt(S.predictions(spark, sf), FIT_ROWS).select("sample_id", "score", "calibrated"), "score", "calibrated", places=5)


@query()
def calibrate_isotonic(spark, sf):
    return with_rounded(M.isotonic(S.predictions(spark, sf), FIT_ROWS).select("sample_id", "score", "calibrated"), "score", "calibrated", places=5)


_NLL = "avg(greatest(z / tt, 0.0) - z / tt * y + ln(1 + exp(-abs(z / tt))))"
TEMP = f"""zy AS (SELECT ln(p / (1 - p)) AS z, y_true::DOUBLE AS y FROM (SELECT least(greatest(score, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, y_true FROM preds)),
g1 AS (SELECT k, pow(10::DOUBLE, -3 + 6 * k / 60.0::DOUBLE) AS tt FROM (SELECT unnest(generate_series(0, 60)) AS k)), l1 AS (SELECT k, {_NLL} AS nll FROM zy, g1 GROUP BY 1), b1 AS (SELECT arg_min(k, nll) AS k FROM l1),
g2 AS (SELECT pow(10::DOUBLE, lo + (hi - lo) * i / 60.0::DOUBLE) AS tt FROM (SELECT -3 + 6 * greatest(k - 1, 0) / 60.0::DOUBLE AS lo, -3 + 6 * least(k + 1, 60) / 60.0::DOUBLE AS hi FROM b1), (SELECT unnest(generate_series(0, 60)) AS i) x), l2 AS (SELECT tt, {_NLL} AS nll FROM zy, g2 GROUP BY 1)"""


@query(with_("preds", more=TEMP) + "SELECT round(arg_min(tt, nll), 4) + 0.0 AS temperature, round(min(nll), 4) + 0.0 AS nll FROM l2")
def temperature_fit(spark, sf):
    return with_rounded(M.temperature(S.predictions(spark, sf)), "temperature", "nll", places=4)


@query()
def head_scores(spark, sf):
    """A head on the given embeddings with soft labels, fitted on one half of the rows and used on all."""
    e = S.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    p = F.when(F.col("label") % 2 == 0, 0.8).otherwise(0.1)
    head = T.train_head(e.withColumn("p", p).where("pmod(xxhash64(vec_id), 2) = 0"))
    return with_rounded(head.transform(e).select("vec_id", "score"), "score", places=4)


CANDW = """cq AS (SELECT DISTINCT ticker, asof_date, setup, cand_length, cand_end_offset FROM (SELECT ticker, asof_date, setup, cand_length, cand_end_offset FROM (%s))),
cw AS (SELECT substr(sha1(upper(cq.ticker) || '|' || CAST(asof_date AS VARCHAR) || '|' || setup), 1, 16) AS sample_id, d.session_no - (a.session_no - 99) AS t, 99 - cand_end_offset AS e, cand_length, b.open, CASE WHEN d.date <> asof_date THEN b.close END AS close
  FROM cq JOIN sess a ON a.date = asof_date JOIN sess d ON d.session_no BETWEEN a.session_no - 99 AND a.session_no LEFT JOIN bars b ON b.ticker = cq.ticker AND b.date = d.date WHERE a.session_no >= 99)"""


@query(with_("last", "sess", more=CIND + ",\n" + CFLAG + ",\n" + CANDW % EVERY_SQL) + "SELECT sample_id, count(*) AS n, count(close) AS valid, count(*) FILTER (t BETWEEN e - cand_length + 1 AND e) AS n_inside, round(sum(open * (t + 1)) FILTER (t BETWEEN e - cand_length + 1 AND e), 3) + 0.0 AS weighted FROM cw GROUP BY 1")
def candidate_windows(spark, sf):
    """Windows of the latest candidates: their rows, valid ones, and those of the candidate itself."""
    bar = written(S.bars(spark, sf))
    _, rows = J.candidate_windows(C.every(B.last_n(bar)), S.sessions(bar), bar, 100)
    inside = F.when(F.col("inside"), F.col("open") * (F.col("t") + 1))
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.count("close").alias("valid"), F.count_if("inside").alias("n_inside"), rounded(F.sum(inside), 3).alias("weighted"))


@query()
def rerank_latest(spark, sf):
    """Latest candidates, scored by a head that was fitted on the embedded windows of labelled samples, the highest 200."""
    bar, samp, sess = base(spark, sf)
    head = J.reranker(samp, sess, bar, size=100)
    out = J.rerank(C.every(B.last_n(bar)), sess, bar, head, size=100)
    return with_rounded(out.where(F.col("rank") <= 200).select("sample_id", "ticker", "setup", "cand_t_end", "score", "rank"), "score", places=4)


@query()
def regime_hmm(spark, sf):
    """Regime probabilities with yearly refits, which know no bar from their own year on."""
    return with_rounded(regime_rows(S.bars(spark, sf)), "p_trend", places=4)


# ------------------------------------------------------------------ run tables, stream


RUNS = "SELECT 'model' || (user_id % 2) AS model, event_type AS setup, 'run' || event_id AS run, round(value, 4) + 0.0 AS value, CAST(user_id AS VARCHAR) AS user FROM events"


@query(RUNS)
def run_index(spark, sf):
    """Every event is a run folder with a metrics file, flattened again."""
    return runs_of(S.table(spark, sf, "events"))


RUN_DAYS = "rd AS (SELECT 'model' || (user_id % 2) AS model, event_type AS setup, strftime(ts, '%Y%m%d') AS run, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2, 3)"


def run_files(spark, sf):
    """A folder of run files `<model>/<setup>/<run>/*.json`, one for each model, type and day of events."""
    path = shared_dir(spark) + "/runs"
    model = F.concat(F.lit("model"), (F.col("user_id") % 2).cast("string")).alias("model")
    days = S.table(spark, sf, "events").groupBy(model, F.col("event_type").alias("setup"), F.date_format("ts", "yyyyMMdd").alias("run")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    text = F.to_json(F.struct("n", F.struct("users").alias("seen")))
    days.select("model", "setup", "run", text.alias("value")).repartition("model", "setup", "run").write.partitionBy("model", "setup", "run").option("compression", "none").text(path)
    return path


@query(f"WITH {RUN_DAYS} SELECT model, setup, run, n, users FROM rd")
def run_folders(spark, sf):
    """Run files read from their folders."""
    idx = R.read_runs(spark, run_files(spark, sf), "*.txt")
    pick = lambda name: F.element_at(F.filter(F.map_entries("entries"), lambda e: e["key"].endswith(name)), 1)["value"].cast("long")
    return idx.select("model", "setup", "run", pick(".n").alias("n"), pick(".seen.users").alias("users"))


@query(f"WITH {RUN_DAYS} " + """SELECT model, setup, run, sha256('{"n":' || n || ',"seen":{"users":' || users || '}}' || chr(10)) AS digest FROM rd""")
def file_digests(spark, sf):
    """Digests of the bytes of run files."""
    d = R.digests(spark, run_files(spark, sf), "*.txt")
    return d.select(*(F.regexp_extract("path", rf"{c}=([^/]*)/", 1).alias(c) for c in ("model", "setup", "run")), "digest")


def runs_of(e):
    path = F.concat_ws("/", F.lit("runs"), F.concat(F.lit("model"), (F.col("user_id") % 2).cast("string")), "event_type", F.concat(F.lit("run"), F.col("event_id").cast("string")), F.lit("metrics.json"))
    text = F.to_json(F.struct(F.struct(F.col("value").alias("value"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("test"), F.array(F.lit(1), F.lit(2)).alias("ks")))
    idx = R.run_index(e.select(path.alias("path"), text.alias("value")))
    return idx.select("model", "setup", "run", rounded(F.try_element_at("entries", F.lit("metrics.test.value")).cast("double"), 4).alias("value"), F.try_element_at("entries", F.lit("metrics.test.user.id")).alias("user"))


@query(with_("bars") + f"SELECT ticker, date, {rs('close')}, volume FROM bars")
def index_sink(spark, sf):
    """Bars written and read in each format of the sink."""
    base_dir = shared_dir(spark)
    bar = S.bars(spark, sf).select("ticker", "date", "close", "volume")
    R.write_table(bar, f"{base_dir}/a.parquet")
    one = spark.read.schema(bar.schema).parquet(f"{base_dir}/a.parquet")
    R.write_table(one, f"{base_dir}/b.csv")
    two = spark.read.schema(bar.schema).option("header", True).csv(f"{base_dir}/b.csv")
    R.write_table(two, f"{base_dir}/c.jsonl")
    return with_rounded(spark.read.schema(bar.schema).json(f"{base_dir}/c.jsonl"), "close")


STREAM = with_("bars") + "SELECT ticker, date, round(CASE WHEN day(date) % 4 = 0 THEN close * 1.01 ELSE close END, 6) + 0.0 AS close, volume FROM bars"


@query(STREAM)
def bars_upsert_stream(spark, sf):
    """Two drops of all bars, the later with corrections, streamed into a table by date."""
    return streamed(spark, S.bars(spark, sf))


def streamed(spark, bar):
    base_dir = shared_dir(spark)
    bar = bar.select("ticker", "date", "close", "volume", F.lit("2000-01-01").cast("timestamp").alias("asof_ts"))
    bar.write.parquet(f"{base_dir}/drops")
    fix = bar.where(F.dayofmonth("date") % 4 == 0).withColumn("close", F.col("close") * 1.01).withColumn("asof_ts", F.lit("2000-02-01").cast("timestamp"))
    for rows in (None, fix):
        if rows is not None:
            rows.write.mode("append").parquet(f"{base_dir}/drops")
        start_stream(spark, f"{base_dir}/drops", bar.schema, f"{base_dir}/table", f"{base_dir}/state").awaitTermination()
    return with_rounded(spark.read.schema(bar.schema).parquet(f"{base_dir}/table").select("ticker", "date", "close", "volume"), "close")


@query(with_("last") + f"SELECT ticker, date, {rs('close')}, {rs('ret_1d', 'ret_5d', 'ret_21d', 'vol_avg_20', 'dollar_vol_avg_20', 'range_pct', places=4)}, rn FROM last")
def last_bars_stream(spark, sf):
    """The last 100 bars and their features, kept up by a stream over three drops in no order, the last with corrections."""
    base_dir = shared_dir(spark)
    bar = S.bars(spark, sf).withColumn("asof_ts", F.lit("2000-01-02").cast("timestamp"))
    part = F.pmod(F.xxhash64("ticker", "date"), F.lit(3))
    wrong = bar.where(part == 1).withColumn("close", F.col("close") * 2).withColumn("asof_ts", F.lit("2000-01-01").cast("timestamp"))
    for rows in (bar.where(part == 0), wrong, bar.where(part > 0)):
        rows.write.mode("append").parquet(f"{base_dir}/drops")
        latest.last_bars_stream(spark, f"{base_dir}/drops", f"{base_dir}/table", f"{base_dir}/state").awaitTermination()
    rows = latest.read_last(spark, f"{base_dir}/table").select("ticker", "date", "close", *B.FEATURES, "rn")
    return with_rounded(with_rounded(rows, "close"), *B.FEATURES, places=4)


@query((with_("bars") + """, x AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars), e AS (SELECT ticker, i, close AS y FROM x WHERE i = 1 UNION ALL SELECT x.ticker, x.i, 2.0::DOUBLE / 21 * close + (1 - 2.0::DOUBLE / 21) * y FROM e JOIN x ON x.ticker = e.ticker AND x.i = e.i + 1)
SELECT ticker, date, round(y, 6) + 0.0 AS ema_20 FROM e JOIN x USING (ticker, i)""").replace("WITH ", "WITH RECURSIVE ", 1))
def ema_history(spark, sf):
    """Exponential means over whole histories, each line cut to chunks."""
    df = ema_scan(S.bars(spark, sf).select("ticker", "date", "close"), ["ticker"], "date", "close", 20, out="ema_20")
    return df.select("ticker", "date", rounded("ema_20").alias("ema_20"))
