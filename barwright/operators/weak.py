"""Weak supervision: features around samples, labelling functions as expressions, votes and label models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import true_range
from ..functions.scalars import ratio, sample_key
from ..sources.shared import written
from .windows import context

# ------------------------------------------------------------------ features


def context_features(ctx: DataFrame, cons: int = 8, impulse: int = 10, atr: int = 14) -> DataFrame:
    """One row for each sample from its context rows (t_rel <= 0 past, > 0 future): one exchange, the window for true
    ranges and all conditional aggregates share it.

    Consolidation: the last `cons` bars before the as-of bar; its range is also given over their median close, and its
    slope is of ln(1 + volume). Impulse: the return from the first to the last of the `impulse` bars before the as-of bar.
    """
    w = Window.partitionBy("sample_id").orderBy("t_rel")
    rows = ctx.withColumn("tr", true_range("high", "low", F.lag("close").over(w), first=True))
    at = lambda t, c: F.max(F.when(F.col("t_rel") == t, F.col(c)))
    inside = lambda c, lo, hi: F.when(F.col("t_rel").between(lo, hi), F.col(c))
    g = rows.groupBy("sample_id").agg(
        at(-1, "close").alias("prev_close"), *(at(0, c).alias(f"asof_{c}") for c in ("open", "high", "low", "close", "volume")),
        F.avg(inside("volume", -20, -1)).alias("past_vol_avg20"), F.max(inside("high", -cons, -1)).alias("cons_high"), F.min(inside("low", -cons, -1)).alias("cons_low"),
        F.regr_slope(F.log1p(inside("volume", -cons, -1).cast("double")), inside("t_rel", -cons, -1).cast("double")).alias("cons_vol_slope"),
        F.avg(inside("tr", -atr, -1)).alias("atr"), F.percentile(inside("close", -cons, -1), 0.5).alias("_mid"), F.min_by("close", inside("t_rel", -impulse, -1)).alias("_from"),
        F.max(inside("close", 1, 1 << 20)).alias("future_max_close"), F.min(inside("close", 1, 1 << 20)).alias("future_min_close"),
    )
    span = F.col("cons_high") - F.col("cons_low")
    return g.select(
        "*", ratio("asof_volume", "past_vol_avg20").alias("volume_shock"), (ratio("asof_open", "prev_close") - 1).alias("gap_pct"), ratio(span, "_mid").alias("cons_range_pct"),
        ratio(span, "atr").alias("cons_range_atr"), (ratio("prev_close", "_from") - 1).alias("impulse_return"),
    ).drop("_mid", "_from")


# ------------------------------------------------------------------ labelling functions


@dataclass(frozen=True)
class LabelingFunction:
    """A name and an expression for the vote: 1, -1 or 0 (abstains). A NULL vote abstains; any other fails the job."""

    name: str
    vote: Column | Callable[[], Column]

    def column(self) -> Column:
        v = F.coalesce((self.vote() if callable(self.vote) else self.vote).cast("int"), F.lit(0))
        return F.when(F.assert_true(v.isin(-1, 0, 1), F.lit(f"{self.name}: a vote isn't -1, 0 or 1")).isNull(), v).alias(self.name)


def _if(sign: int, *conditions: str) -> Callable[[], Column]:
    return lambda: F.when(F.expr(" AND ".join(f"({c})" for c in conditions)), sign).otherwise(0)


#: Thresholds of the rules.
FLAG_RULES = {
    "lf_flag_impulse": (1, "impulse_return > 0.12", "cons_range_pct < 0.08", "cons_vol_slope < 0"),
    "lf_flag_breakout": (1, "asof_open <= cons_high * 1.01", "future_max_close >= cons_high * 1.03"),
    "lf_flag_tight": (1, "impulse_return > 0.10", "cons_low / nullif(cons_high, 0) >= 0.85"),
    "lf_flag_shock": (1, "cons_range_pct < 0.06", "volume_shock > 1.8", "gap_pct > -0.02"),
    "lf_flag_wide": (-1, "cons_range_pct > 0.15"),
    "lf_flag_deep": (-1, "cons_low / nullif(cons_high, 0) < 0.75"),
    "lf_flag_gap_down": (-1, "gap_pct < -0.03"),
    "lf_flag_breakdown": (-1, "future_min_close <= cons_low * 0.97"),
}
GAP_GO_RULES = {
    "lf_go_hold": (1, "gap_pct >= 0.03", "asof_low >= prev_close", "asof_close >= asof_open"),
    "lf_go_strong": (1, "gap_pct >= 0.04", "(asof_close - asof_low) / nullif(asof_high - asof_low, 0) >= 0.7"),
    "lf_go_volume": (1, "gap_pct >= 0.03", "volume_shock >= 1.5"),
    "lf_go_filled": (-1, "gap_pct >= 0.03", "asof_close <= prev_close"),
    "lf_go_weak": (-1, "gap_pct >= 0.03", "asof_close < asof_open"),
}
GAP_FADE_RULES = {
    "lf_fade_touch": (1, "gap_pct >= 0.03", "asof_low <= prev_close"),
    "lf_fade_close": (1, "gap_pct >= 0.03", "asof_close <= prev_close"),
    "lf_fade_red": (1, "gap_pct >= 0.03", "asof_close < asof_open"),
    "lf_fade_held": (-1, "gap_pct >= 0.03", "asof_low >= prev_close", "asof_close >= asof_open"),
}
RULES = {"flag": FLAG_RULES, "gap_go": GAP_GO_RULES, "gap_fade": GAP_FADE_RULES}


def rules(name: str) -> list[LabelingFunction]:
    return [LabelingFunction(k, _if(*v)) for k, v in RULES[name].items()]


def votes(feats: DataFrame, functions: list[LabelingFunction], key: str = "sample_id") -> DataFrame:
    """The vote matrix: key and a column for each function."""
    return feats.select(key, *(f.column() for f in functions))


# ------------------------------------------------------------------ votes


def _sum(cs: list[Column]) -> Column:
    return sum(cs[1:], cs[0])


def vote_stats(matrix: DataFrame, names: list[str]) -> DataFrame:
    pos, neg = (_sum([(F.col(c) == s).cast("int") for c in names]) for s in (1, -1))
    rows = matrix.withColumn("pos", pos).withColumn("neg", neg)
    return rows.withColumn("abstain", F.lit(len(names)) - F.col("pos") - F.col("neg")).withColumn("conflict", (F.col("pos") > 0) & (F.col("neg") > 0)).withColumn("emitted", F.col("pos") + F.col("neg"))


def majority(matrix: DataFrame, names: list[str]) -> DataFrame:
    """p = pos / (pos + neg), 0.5 without votes; hard label p >= 0.5; weight: how far the votes agree, 0 without."""
    s = vote_stats(matrix, names)
    p = F.coalesce(ratio("pos", "emitted"), F.lit(0.5))
    weight = F.coalesce(ratio(F.greatest("pos", "neg"), "emitted"), F.lit(0.0))
    return s.withColumn("p_label", p).withColumn("label_hard", p >= 0.5).withColumn("weight", weight)


def signature(names: list[str]) -> Column:
    return F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(names)))


def summary(matrix: DataFrame, names: list[str]) -> DataFrame:
    """(lf, n, pos, neg, abstain, coverage, pos_rate) of each function."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("lf"), F.col(c).alias("v")) for c in names)))
    g = matrix.select(pairs.alias("x")).groupBy(F.col("x.lf").alias("lf")).agg(F.count("*").alias("n"), F.count_if(F.col("x.v") == 1).alias("pos"), F.count_if(F.col("x.v") == -1).alias("neg"))
    return g.select("*", (F.col("n") - F.col("pos") - F.col("neg")).alias("abstain"), ((F.col("pos") + F.col("neg")) / F.col("n")).alias("coverage"), ratio("pos", F.col("pos") + F.col("neg")).alias("pos_rate"))


MASK_BITS = 60  # functions in a pair of masks


def _masks(names: list[str]) -> dict[str, Column]:
    """Votes packed in bit masks: `p0`, `n0`, `p1` ... have a bit for each positive and negative vote."""
    out = {}
    for k in range(0, len(names), MASK_BITS):
        for kind, sign in (("p", 1), ("n", -1)):
            out[f"{kind}{k // MASK_BITS}"] = _sum([F.when(F.col(c) == sign, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(names[k : k + MASK_BITS])])
    return out


def _vote(j: int) -> Column:
    """The vote of function j: 1, -1 or 0."""
    bit = lambda kind: F.shiftright(F.col(f"{kind}{j // MASK_BITS}"), j % MASK_BITS).bitwiseAND(F.lit(1).cast("bigint"))
    return (bit("p") - bit("n")).cast("double")


def _log_odds(votes: list[Column], pi: float, acc: np.ndarray) -> Column:
    """Log odds of the label: every vote adds or takes the log odds of its function's accuracy."""
    w = np.log(acc) - np.log(1 - acc)
    return _sum([F.lit(float(np.log(pi) - np.log(1 - pi))), *(v * float(x) for v, x in zip(votes, w, strict=True))])


def _posterior(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


COLLECTED_PATTERNS = 4_096


def label_model(matrix: DataFrame, names: list[str], *, iterations: int = 50, tolerance: float = 1e-6, prior: float = 0.2, collected: int = COLLECTED_PATTERNS) -> tuple[DataFrame, dict]:
    """matrix with p_label, label_hard, weight (the larger of p and 1 - p; 0 without votes) and emitted, by a model with
    independent functions, fitted by EM, and its parameters: prior, accuracy and coverage.

    Rows with the same votes have the same posterior, so EM runs on patterns: votes packed in bit masks and counted by one
    aggregation. Up to `collected` patterns, by their count, are fitted on the driver; more are written, and each
    iteration is one aggregation over them that gives two sums and one for each function. Posteriors need no join: they
    are an expression of a row's own votes and the parameters. Any number of functions can vote.
    """
    if not names:
        raise ValueError("no labelling functions")
    masks = _masks(names)
    patterns = written(matrix.select(*(v.alias(k) for k, v in masks.items())).groupBy(*masks).agg(F.count("*").alias("n")))
    few = patterns.count() <= collected
    m = len(names)
    if few:
        rows = patterns.select("n", *(_vote(j).alias(f"v{j}") for j in range(m))).collect()
        v = np.array([[r[f"v{j}"] for j in range(m)] for r in rows], float).reshape(-1, m)
        n = np.array([r.n for r in rows], float)

        def sums(pi: float, acc: np.ndarray) -> tuple[float, float, np.ndarray]:
            z = np.log(pi) - np.log(1 - pi) + v @ (np.log(acc) - np.log(1 - acc))
            miss = np.log(1 - pi) + np.where(v == 1, np.log(1 - acc), np.where(v == -1, np.log(acc), 0.0)).sum(1)
            post = 1 / (1 + np.exp(-z))
            return float((n * (miss + np.logaddexp(0, z))).sum()), float((n * post).sum()), (n[:, None] * np.where(v == 1, post[:, None], np.where(v == -1, 1 - post[:, None], 0.0))).sum(0)

        total, emitted = float(n.sum()), (n[:, None] * (v != 0)).sum(0)
    else:
        votes = [_vote(j) for j in range(m)]
        first = patterns.agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.abs(x)).alias(f"e{j}") for j, x in enumerate(votes))).first()
        total, emitted = float(first.n), np.array([first[f"e{j}"] for j in range(m)], float)

        def sums(pi: float, acc: np.ndarray) -> tuple[float, float, np.ndarray]:
            up, down = np.log(acc), np.log(1 - acc)
            z = _log_odds(votes, pi, acc)
            miss = _sum([F.lit(float(np.log(1 - pi))), *(F.when(x == 1, float(down[j])).when(x == -1, float(up[j])).otherwise(0.0) for j, x in enumerate(votes))])
            fit = patterns.withColumns({"z": z, "miss": miss}).withColumn("post", _posterior(F.col("z")))
            loss = F.col("miss") + F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
            right = [F.sum(F.col("n") * F.when(x == 1, F.col("post")).when(x == -1, 1 - F.col("post")).otherwise(0.0)).alias(f"r{j}") for j, x in enumerate(votes)]
            got = fit.agg(F.sum(F.col("n") * loss).alias("loss"), F.sum(F.col("n") * F.col("post")).alias("post"), *right).first()
            return float(got.loss), float(got.post), np.array([got[f"r{j}"] for j in range(m)], float)

    pi, acc, last = float(np.clip(prior, 1e-3, 1 - 1e-3)), np.full(m, 0.7), None
    used = (pi, acc)  # what posteriors come from: the parameters of the last pass that was measured
    for _ in range(iterations if total else 0):
        used = (pi, acc)
        loss, positive, right = sums(pi, acc)
        if last is not None and abs(loss - last) < tolerance:
            break
        last = loss
        pi = float(np.clip(positive / total, 1e-3, 1 - 1e-3))
        acc = np.where(emitted > 0, np.clip(right / np.maximum(emitted, 1.0), 0.55, 0.95), 0.5)
    out = matrix.withColumn("p_label", _posterior(_log_odds([F.col(c).cast("double") for c in names], *used)))
    out = out.withColumn("label_hard", F.col("p_label") >= 0.5).withColumn("emitted", _sum([(F.col(c) != 0).cast("int") for c in names]))
    out = out.withColumn("weight", F.when(F.col("emitted") > 0, F.greatest(F.col("p_label"), 1 - F.col("p_label"))).otherwise(0.0))
    cover = emitted / max(total, 1.0)
    return out, {"prior": pi, "accuracy": dict(zip(names, acc.tolist(), strict=True)), "coverage": dict(zip(names, cover.tolist(), strict=True))}


def pseudo_labels(pool: DataFrame, sessions: DataFrame, bar: DataFrame, *, setup: str = "flag", past: int = 48, future: int = 32, combine: str = "label_model", head: int = 0, version: str = "v1") -> DataFrame:
    """Weak labels of a candidate pool(ticker, asof_date, setup, ...): its rows of `setup` (the first `head` of the newest and
    most traded ones if given), their contexts and features, votes, and votes combined by `majority` or `label_model`.

    The pool's columns stay; sample_id, p_label, weight, label, label_def_version and lf_config_hash (of all options) are
    new. Rows without a whole context in the calendar go.
    """
    if setup not in RULES:
        raise ValueError(f"setup must be one of {sorted(RULES)}")
    if combine not in ("majority", "label_model"):
        raise ValueError("combine must be majority or label_model")
    rows = pool.withColumn("ticker", F.upper("ticker")).where(F.col("setup") == setup)
    if head:
        rows = rows.orderBy(F.desc("asof_date"), F.desc("dollar_vol"), "ticker").limit(head)
    rows = rows.withColumn("sample_id", sample_key("ticker", "asof_date", "setup"))
    keys = rows.select("sample_id", "ticker", "asof_date", "setup", F.lit(None).cast("boolean").alias("label"))
    matrix = votes(context_features(context(keys, sessions, bar, past, future)), rules(setup))
    names = list(RULES[setup])
    post = majority(matrix, names) if combine == "majority" else label_model(matrix, names)[0]
    options = {"setup": setup, "past_window": past, "future_window": future, "combine": combine, "label_def_version": version}
    name = hashlib.sha1(json.dumps(options, sort_keys=True).encode()).hexdigest()
    found = post.select("sample_id", "p_label", "weight", F.col("label_hard").alias("label"))
    return rows.join(found, "sample_id").withColumn("label_def_version", F.lit(version)).withColumn("lf_config_hash", F.lit(name))


def candidate_pool(bar: DataFrame, setups: tuple[str, ...], start: str | None, end: str | None, min_close: float, min_dollar_vol: float = 0.0, top: int | None = None) -> DataFrame:
    """Bars of a span (open where an end is None) that pass the thresholds, newest and most traded first, times setups."""
    df = bar.where("close is not null and volume is not null").where(F.col("close") >= min_close)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    df = df.select("ticker", F.col("date").alias("asof_date"), "close", "volume", (F.col("close") * F.col("volume")).alias("dollar_vol"))
    if min_dollar_vol > 0:
        df = df.where(F.col("dollar_vol") >= min_dollar_vol)
    if top:
        df = df.orderBy(F.desc("asof_date"), F.desc("dollar_vol"), "ticker").limit(top)
    return df.withColumn("setup", F.explode(F.array(*(F.lit(s) for s in setups)))).withColumn("source", F.lit("pool"))
