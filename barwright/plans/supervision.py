"""Queries on weak supervision, metrics, priors and scores."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..functions.scalars import ratio, rounded
from ..operators import bars as B
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import weak as K
from ..operators import windows as W
from ..operators.asof import asof_join
from ..sources import runs as R
from ..sources import tables as S
from ..sources.shared import shared_dir
from .market import with_rounded
from .registry import query
from .samples import base
from .sql import r, rs, with_

CF = ("prev_close", "asof_open", "asof_high", "asof_low", "asof_close", "asof_volume", "past_vol_avg20", "cons_high", "cons_low", "cons_vol_slope", "atr", "future_max_close", "future_min_close", "volume_shock", "gap_pct", "cons_range_pct", "cons_range_atr", "impulse_return")
AT = ", ".join(f"max({c}) FILTER (t_rel = 0) AS asof_{c}" for c in ("open", "high", "low", "close", "volume"))
CTXF = f"""ctr AS (SELECT *, lag(close) OVER w AS pc FROM ctx WINDOW w AS (PARTITION BY sample_id ORDER BY t_rel)),
cf0 AS (SELECT sample_id, max(close) FILTER (t_rel = -1) AS prev_close, {AT}, avg(volume) FILTER (t_rel BETWEEN -20 AND -1) AS past_vol_avg20, max(high) FILTER (t_rel BETWEEN -8 AND -1) AS cons_high, min(low) FILTER (t_rel BETWEEN -8 AND -1) AS cons_low,
  regr_slope(ln(1 + volume::DOUBLE), t_rel::DOUBLE) FILTER (t_rel BETWEEN -8 AND -1) AS cons_vol_slope, avg(greatest(high - low, abs(high - pc), abs(low - pc))) FILTER (t_rel BETWEEN -14 AND -1) AS atr,
  quantile_cont(close, 0.5) FILTER (t_rel BETWEEN -8 AND -1) AS mid, max(close) FILTER (t_rel = -10) AS c0, max(close) FILTER (t_rel > 0) AS future_max_close, min(close) FILTER (t_rel > 0) AS future_min_close FROM ctr GROUP BY 1),
cf AS (SELECT *, asof_volume / nullif(past_vol_avg20, 0) AS volume_shock, asof_open / nullif(prev_close, 0) - 1 AS gap_pct, (cons_high - cons_low) / nullif(mid, 0) AS cons_range_pct, (cons_high - cons_low) / nullif(atr, 0) AS cons_range_atr, prev_close / nullif(c0, 0) - 1 AS impulse_return FROM cf0)"""


def feats(spark, sf):
    bar, samp, sess = base(spark, sf)
    return K.context_features(W.context(samp, sess, bar, 20, 5))


@query(with_("ctx", more=CTXF) + f"SELECT sample_id, {rs(*CF, places=7)} FROM cf")
def context_features(spark, sf):
    return with_rounded(feats(spark, sf).select("sample_id", *CF), *CF, places=7)


def _lf_sql(name):
    cols = ", ".join(f"CASE WHEN {' AND '.join(f'({c})' for c in v[1:])} THEN {v[0]} ELSE 0 END AS {k}" for k, v in K.RULES[name].items())
    return f"SELECT sample_id, {cols} FROM cf"


def matrix(spark, sf, name="flag"):
    return K.votes(feats(spark, sf), K.rules(name))


@query(with_("ctx", more=CTXF) + _lf_sql("flag"))
def lf_flag(spark, sf):
    return matrix(spark, sf)


@query(with_("ctx", more=CTXF) + _lf_sql("gap_go"))
def lf_gap_go(spark, sf):
    return matrix(spark, sf, "gap_go")


@query(with_("ctx", more=CTXF) + _lf_sql("gap_fade"))
def lf_gap_fade(spark, sf):
    return matrix(spark, sf, "gap_fade")


@query(with_("ctx", more=CTXF) + "SELECT sample_id, CASE WHEN gap_pct > 0 THEN 1 WHEN gap_pct < 0 THEN -1 ELSE 0 END AS lf_sign, CASE WHEN volume_shock > 2 THEN 1 ELSE 0 END AS lf_loud FROM cf")
def lf_matrix(spark, sf):
    """Labelling functions that a user brings along."""
    own = [K.LabelingFunction("lf_sign", lambda: F.signum("gap_pct")), K.LabelingFunction("lf_loud", lambda: F.when(F.col("volume_shock") > 2, 1))]
    return K.votes(feats(spark, sf), own)


FLAGS = list(K.FLAG_RULES)
POS = " + ".join(f"CAST({c} = 1 AS INTEGER)" for c in FLAGS)
NEG = " + ".join(f"CAST({c} = -1 AS INTEGER)" for c in FLAGS)
VOTES = f"m AS ({_lf_sql('flag')}), vs AS (SELECT *, {POS} AS pos, {NEG} AS neg FROM m)"
LFV = CTXF + ", " + VOTES


@query(with_("ctx", more=LFV) + "SELECT sample_id, pos, neg, 8 - pos - neg AS abstain, pos > 0 AND neg > 0 AS conflict, pos + neg AS emitted FROM vs")
def vote_stats(spark, sf):
    return K.vote_stats(matrix(spark, sf), FLAGS).select("sample_id", "pos", "neg", "abstain", "conflict", "emitted")


MAJ = "maj AS (SELECT sample_id, coalesce(pos / nullif(pos + neg, 0)::DOUBLE, 0.5) AS p_label, coalesce(greatest(pos, neg) / nullif(pos + neg, 0)::DOUBLE, 0.0) AS weight FROM vs)"


@query(with_("ctx", more=LFV + ", " + MAJ) + f"SELECT sample_id, {rs('p_label', 'weight')}, p_label >= 0.5 AS label_hard FROM maj")
def majority_vote(spark, sf):
    return with_rounded(K.majority(matrix(spark, sf), FLAGS).select("sample_id", "p_label", "weight", "label_hard"), "p_label", "weight")


@query(with_("ctx", more=LFV) + "SELECT sample_id, " + " || '|' || ".join(f"'{c}=' || {c}" for c in sorted(FLAGS)) + " AS signature FROM m")
def lf_signature(spark, sf):
    return matrix(spark, sf).select("sample_id", K.signature(FLAGS).alias("signature"))


@query(with_("ctx", more=LFV) + ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS lf, {c} AS v FROM m" for c in FLAGS) + ") SELECT lf, count(*) AS n, count(*) FILTER (v = 1) AS pos, count(*) FILTER (v = -1) AS neg, count(*) FILTER (v = 0) AS abstain, round(count(*) FILTER (v <> 0) / count(*)::DOUBLE, 6) + 0.0 AS coverage, round(count(*) FILTER (v = 1) / nullif(count(*) FILTER (v <> 0), 0)::DOUBLE, 6) + 0.0 AS pos_rate FROM u GROUP BY 1")
def lf_summary(spark, sf):
    return with_rounded(K.summary(matrix(spark, sf), FLAGS), "coverage", "pos_rate")


@query()
def label_model(spark, sf):
    """Posteriors of the generative label model."""
    post, _ = K.label_model(matrix(spark, sf), FLAGS)
    return with_rounded(post.select("sample_id", "p_label", "label_hard", "weight", "emitted"), "p_label", "weight")


POOL = "date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND close >= 2 AND close * volume >= 20000"


@query(with_("bars") + f"SELECT ticker, asof_date, round(close, 6) + 0.0 AS close, volume, round(dollar_vol, 4) + 0.0 AS dollar_vol, setup, 'pool' AS source FROM (SELECT ticker, date AS asof_date, close, volume, close * volume AS dollar_vol FROM bars WHERE {POOL} ORDER BY date DESC, close * volume DESC, ticker LIMIT 200) CROSS JOIN (SELECT unnest(['flag', 'gap_go']) AS setup)")
def candidate_pool(spark, sf):
    df = K.candidate_pool(S.bars(spark, sf), ("flag", "gap_go"), "1996-01-01", "1996-03-31", 2.0, 20000.0, 200)
    return with_rounded(with_rounded(df, "close"), "dollar_vol", places=4)


ALL_POOL = "SELECT substr(sha1(upper(ticker) || '|' || CAST(date AS VARCHAR) || '|flag'), 1, 16) AS sample_id, upper(ticker) AS ticker, date AS asof_date, 'flag' AS setup, NULL AS label FROM bars WHERE close >= 2 AND close * volume >= 20000"
PSEUDO = {"combine": "majority", "future_window": 5, "label_def_version": "v1", "past_window": 20, "setup": "flag"}
PSEUDO_HASH = hashlib.sha1(json.dumps(PSEUDO, sort_keys=True).encode()).hexdigest()


@query(with_("ctx", more=LFV + ", " + MAJ, samp=ALL_POOL.replace("upper(ticker) AS ticker", "ticker")) + f"SELECT upper(s.ticker) AS ticker, s.asof_date, s.setup, {rs('p_label', 'weight')}, p_label >= 0.5 AS label, 'v1' AS label_def_version, '{PSEUDO_HASH}' AS lf_config_hash FROM samp s JOIN maj ON maj.sample_id = s.sample_id")
def pseudo_labels(spark, sf):
    """The pool of all liquid bars, contexts, features, votes and majority, joined back to the pool; written as Parquet and as
    CSV, and the CSV read again."""
    bar = S.bars(spark, sf)
    pool = K.candidate_pool(bar, ("flag", "gap_go"), None, None, 2.0, 20000.0)
    out = K.pseudo_labels(pool, S.sessions(bar), bar.withColumn("ticker", F.upper("ticker")), setup="flag", past=20, future=5, combine="majority")
    folder = shared_dir(spark)
    R.write_table(out, f"{folder}/pseudo_labels.parquet")
    cols = ["ticker", F.col("asof_date").alias("date"), "setup", "label", "p_label", "weight", "label_def_version", "lf_config_hash"]
    R.write_table(spark.read.parquet(f"{folder}/pseudo_labels.parquet").select(*cols), f"{folder}/pseudo_labels.csv")
    back = L.normalized(L.read_csv(spark, f"{folder}/pseudo_labels.csv")).drop("sample_id")
    back = back.withColumns({c: F.col(c).cast("double") for c in ("p_label", "weight")})
    return with_rounded(back, "p_label", "weight")


# ------------------------------------------------------------------ metrics


def preds(spark, sf):
    return S.predictions(spark, sf)


CONF = "count(*) FILTER (score >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (score >= 0.5 AND y_true <> 1) AS fp, count(*) FILTER (score < 0.5 AND y_true = 1) AS fn, count(*) FILTER (score < 0.5 AND y_true <> 1) AS tn"
PRF = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall"


@query(with_("preds") + f", c AS (SELECT {CONF} FROM preds), p AS (SELECT *, {PRF} FROM c) SELECT tp, fp, fn, tn, {rs('precision', 'recall')}, round(coalesce(2 * p.precision * p.recall / nullif(p.precision + p.recall, 0), 0), 6) + 0.0 AS f1 FROM p")
def score_threshold(spark, sf):
    return with_rounded(M.at_threshold(preds(spark, sf), 0.5), "precision", "recall", "f1")


def _auroc_sql(by):
    k = f"{by}, " if by else ""
    p = f"PARTITION BY {by} " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return f"sc AS (SELECT {k}score, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true <> 1) AS q FROM pr GROUP BY {k}score), cu AS (SELECT *, coalesce(sum(q) OVER ({p}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc), ro AS (SELECT {k}sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0) AS auroc FROM cu{g})"


def _auprc_sql(by):
    k = f"{by}, " if by else ""
    p = f"PARTITION BY {by} " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return f"hi AS (SELECT {k}y_true, sum(CAST(y_true = 1 AS INTEGER)) OVER ({p}ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER ({p}ORDER BY score DESC, sample_id) AS rank FROM pr), ap AS (SELECT {k}sum(hits / rank::DOUBLE) FILTER (y_true = 1) / nullif(count(*) FILTER (y_true = 1), 0) AS auprc FROM hi{g})"


@query(with_("preds", more="pr AS (SELECT * FROM preds), " + _auroc_sql("")) + "SELECT round(auroc, 6) + 0.0 AS auroc FROM ro")
def auroc(spark, sf):
    return with_rounded(M.auroc(preds(spark, sf)), "auroc")


@query(with_("preds", more="pr AS (SELECT * FROM preds), " + _auprc_sql("")) + "SELECT round(auprc, 6) + 0.0 AS auprc FROM ap")
def auprc(spark, sf):
    return with_rounded(M.auprc(preds(spark, sf)), "auprc")


@query(with_("preds") + """, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, sample_id) AS rank FROM preds), n AS (SELECT count(*) AS n, count(*) FILTER (y_true = 1) AS p FROM preds)
SELECT k, CAST(least(k, n) AS INTEGER) AS k_eff, round(tp / least(k, n)::DOUBLE, 6) + 0.0 AS precision_at_k, round(tp / nullif(p, 0)::DOUBLE, 6) + 0.0 AS recall_at_k FROM (SELECT g.k, count(*) FILTER (y_true = 1) AS tp FROM (SELECT unnest([25, 50, 100]) AS k) g JOIN k ON rank <= g.k GROUP BY 1) CROSS JOIN n""")
def at_k(spark, sf):
    return with_rounded(M.at_k(preds(spark, sf)), "precision_at_k", "recall_at_k")


REP = "pr AS (SELECT * FROM preds UNION ALL SELECT sample_id, 'all' AS setup, y_true, score FROM preds), bs AS (SELECT setup, count(*) AS n, count(*) FILTER (y_true = 1) AS n_pos, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM pr GROUP BY 1), " + _auroc_sql("setup") + ", " + _auprc_sql("setup") + f", cc AS (SELECT setup, {CONF} FROM pr GROUP BY 1), pc AS (SELECT *, {PRF} FROM cc)"
REP += ", rk AS (SELECT *, row_number() OVER (PARTITION BY setup ORDER BY score DESC, sample_id) AS rank, count(*) OVER (PARTITION BY setup) AS n_s, count(*) FILTER (y_true = 1) OVER (PARTITION BY setup) AS p_s FROM pr), kk AS (SELECT setup, " + ", ".join(f"count(*) FILTER (y_true = 1 AND rank <= {k}) / max(least({k}, n_s))::DOUBLE AS precision_at_{k}, count(*) FILTER (y_true = 1 AND rank <= {k}) / nullif(max(p_s), 0)::DOUBLE AS recall_at_{k}" for k in (25, 50, 100)) + " FROM rk GROUP BY 1)"
REP_COLS = ("mean_score", "std_score", "auroc", "auprc", "precision", "recall", *(f"{c}_at_{k}" for k in (25, 50, 100) for c in ("precision", "recall")))
REP_SQL = f"SELECT bs.setup, n, n_pos, {rs(*REP_COLS)}, round(coalesce(2 * pc.precision * pc.recall / nullif(pc.precision + pc.recall, 0), 0), 6) + 0.0 AS f1 FROM bs JOIN ro ON ro.setup = bs.setup JOIN ap ON ap.setup = bs.setup JOIN pc ON pc.setup = bs.setup JOIN kk ON kk.setup = bs.setup"


@query(with_("preds", more=REP) + REP_SQL)
def score_report(spark, sf):
    return with_rounded(M.report(preds(spark, sf)), *REP_COLS, "f1")


@query(with_("preds", more=REP) + REP_SQL + " WHERE bs.setup <> 'all'")
def score_files(spark, sf):
    """The report's files, and the one by setup read again."""
    folder = shared_dir(spark)
    M.write_report(preds(spark, sf), folder)
    return with_rounded(spark.read.parquet(f"{folder}/metrics_by_setup.parquet"), *REP_COLS, "f1")


@query(with_("preds") + "SELECT setup, count(*) AS n, count(*) FILTER (y_true = 1) AS n_pos, round(avg(score), 6) + 0.0 AS mean_score, round(coalesce(stddev_pop(score), 0), 6) + 0.0 AS std_score FROM preds GROUP BY GROUPING SETS ((), (setup))")
def score_by_setup(spark, sf):
    """Additive metrics over all and by setup, in one pass of grouping sets."""
    return preds(spark, sf).rollup("setup").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 1).alias("n_pos"), rounded(F.avg("score")).alias("mean_score"), rounded(F.stddev_pop("score")).alias("std_score"))


@query(with_("preds") + """, a AS (SELECT sample_id, score, 'uncertain' AS reason FROM preds ORDER BY abs(score - 0.5), preds.score, sample_id LIMIT 30), b AS (SELECT sample_id, score, 'top' AS reason FROM preds ORDER BY preds.score DESC, sample_id LIMIT 30)
SELECT sample_id, round(score, 6) + 0.0 AS score, reason FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE sample_id NOT IN (SELECT sample_id FROM a))""")
def suggest_gold(spark, sf):
    return with_rounded(M.suggest(preds(spark, sf), 30, 30), "score")


@query(with_("preds") + "SELECT setup, sample_id, round(score, 6) + 0.0 AS score FROM preds ORDER BY preds.score DESC, sample_id LIMIT 50")
def scan_rank(spark, sf):
    return with_rounded(preds(spark, sf).orderBy(F.desc("score"), "sample_id").limit(50).select("setup", "sample_id", "score"), "score")


# ------------------------------------------------------------------ priors and weights


def priors(samp):
    """Share of positive labels by setup, and over all (setup NULL)."""
    return samp.rollup("setup").agg(F.avg(F.col("label").cast("double")).alias("prior"), F.count("*").alias("n"))


@query(with_("samp") + "SELECT setup, round(avg(CAST(label AS INTEGER)), 6) + 0.0 AS prior, count(*) AS n FROM samp GROUP BY GROUPING SETS ((), (setup))")
def prior_fit(spark, sf):
    return with_rounded(priors(base(spark, sf)[1]), "prior")


@query(with_("samp") + ", p AS (SELECT setup, avg(CAST(label AS INTEGER)) AS prior FROM samp WHERE setup = 'flag' GROUP BY 1) SELECT sample_id, round(coalesce(prior, (SELECT avg(CAST(label AS INTEGER)) FROM samp)), 6) + 0.0 AS score FROM samp s LEFT JOIN p ON p.setup = s.setup")
def prior_predict(spark, sf):
    """Priors by setup; a setup that the fit hasn't seen takes the one over all."""
    samp = base(spark, sf)[1]
    fit = priors(samp)
    known = fit.where("setup = 'flag'").select("setup", "prior")
    every = fit.where("setup is null").select(F.col("prior").alias("_all"))
    out = samp.join(F.broadcast(known), "setup", "left").crossJoin(F.broadcast(every))
    return out.select("sample_id", rounded(F.coalesce("prior", "_all")).alias("score"))


@query(with_("bars", "sess", "samp") + """, d AS (SELECT max(date) AS asof_date FROM sess), p AS (SELECT setup, avg(CAST(label AS INTEGER)) AS prior FROM samp GROUP BY 1)
SELECT ticker, asof_date, setup, round(prior, 6) + 0.0 AS score FROM (SELECT DISTINCT ticker FROM bars) CROSS JOIN d CROSS JOIN p""")
def scan_universe(spark, sf):
    """Every ticker at the latest session, scored by the prior of each setup, highest first."""
    bar, samp, sess = base(spark, sf)
    day = sess.agg(F.max("date").alias("asof_date"))
    fit = priors(samp).where("setup is not null").select("setup", "prior")
    rows = bar.select("ticker").distinct().crossJoin(F.broadcast(day)).crossJoin(F.broadcast(fit))
    return rows.select("ticker", "asof_date", "setup", rounded("prior").alias("score")).orderBy(F.desc("score"), "ticker", "setup")


@query("SELECT doc_id, least(greatest(coalesce(w, 1.0), 0.0), 1000000.0) AS weight, least(greatest(n_chars / 1000.0::DOUBLE, 0.0), 1.0) AS p FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN -3.0::DOUBLE ELSE doc_id * 10000.0::DOUBLE END AS w FROM documents)")
def weights_clean(spark, sf):
    """Weights: not finite is 1, clipped to [0, 1e6]; probabilities clipped to [0, 1]."""
    docs = S.table(spark, sf, "documents").select("doc_id", "n_chars")
    k = F.col("doc_id")
    raw = docs.withColumn("w", F.when(k % 11 == 0, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).when(k % 7 == 0, F.lit(-3.0)).otherwise(k * 10000.0))
    finite = F.when(~F.isnan("w") & (F.abs("w") < F.lit(float("inf"))), F.col("w"))
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    return raw.select("doc_id", clip(F.coalesce(finite, F.lit(1.0)), 0.0, 1e6).alias("weight"), clip(F.col("n_chars") / 1000.0, 0.0, 1.0).alias("p"))


@query(with_("bars", "samp") + """, ob AS (SELECT ticker, date, 1 / (1 + exp(-((high - low) / nullif(close, 0)))) AS p FROM bars WHERE day(date) % 5 = 0)
SELECT s.sample_id, round(p, 6) + 0.0 AS p_regime FROM samp s ASOF LEFT JOIN ob ON ob.ticker = s.ticker AND s.asof_date > ob.date""")
def asof_regime(spark, sf):
    """The last observation strictly before each sample."""
    bar, samp, _ = base(spark, sf)
    obs = bar.where(F.dayofmonth("date") % 5 == 0).select("ticker", "date", (1 / (1 + F.exp(-ratio(F.col("high") - F.col("low"), "close")))).alias("p_regime"))
    return asof_join(samp.select("sample_id", "ticker", "asof_date"), obs, ["ticker"], "asof_date", "date", ["p_regime"]).select("sample_id", rounded("p_regime").alias("p_regime"))


@query(with_("samp", "feat") + """SELECT sample_id, f.date, round(range_pct, 6) + 0.0 AS range_pct FROM samp s LEFT JOIN (SELECT * FROM feat WHERE day(date) % 5 = 0) f ON f.ticker = s.ticker AND f.date >= s.asof_date AND f.date <= s.asof_date + 3
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY f.date) = 1""")
def asof_forward(spark, sf):
    """The next observation at or after each sample, three days away at most."""
    bar, samp, _ = base(spark, sf)
    obs = B.features(bar).where(F.dayofmonth("date") % 5 == 0).select("ticker", "date", "range_pct")
    out = asof_join(samp.select("sample_id", "ticker", "asof_date"), obs, ["ticker"], "asof_date", "date", ["date", "range_pct"], strict=False, forward=True, tolerance=3)
    return out.select("sample_id", "date", rounded("range_pct").alias("range_pct"))
