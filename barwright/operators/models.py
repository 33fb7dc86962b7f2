"""Classifiers, calibration and the regime model on top of spark.ml and grouped statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .asof import asof_join
from .window_features import impute, impute_fit


def balanced(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Weights n / (2 n_class) of two classes, times a weight that is there."""
    n = df.groupBy(label).agg(F.count("*").alias("_k"))
    total = n.agg(F.sum("_k").alias("_n"))
    w = F.col("_n") / (2 * F.col("_k"))
    joined = df.join(F.broadcast(n), label).crossJoin(F.broadcast(total))
    return joined.withColumn(out, w * F.col(out) if out in df.columns else w).drop("_k", "_n")


def prepared(df: DataFrame, columns: list[str], train: str = "split = 'train'") -> DataFrame:
    """df with `features`: the columns, missing values as the medians of the training rows."""
    filled = impute(df, impute_fit(df.where(train), columns), columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def _scored(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def logistic(df: DataFrame, *, label: str = "y", weight: str = "weight", out: str = "score", train: str = "split = 'train'", ridge: float = 0.01) -> DataFrame:
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, regParam=ridge, maxIter=50).fit(df.where(train))
    return _scored(model, df, out)


def boosted(df: DataFrame, *, label: str = "y", weight: str = "weight", out: str = "score", fit: str = "split <> 'test'", validation: str = "is_val", trees: int = 20, depth: int = 4) -> DataFrame:
    """Gradient-boosted trees that stop when the validation rows get no better."""
    model = GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=depth, stepSize=0.1, validationIndicatorCol=validation, seed=7).fit(df.where(fit))
    return _scored(model, df, out)


def soft_rows(df: DataFrame, p: str, weight: str | None = None) -> DataFrame:
    """Two weighted rows for a soft label p: y = 1 with p, y = 0 with 1 - p; the same cross-entropy."""
    w = F.col(weight) if weight else F.lit(1.0)
    pair = F.array(F.struct(F.lit(1.0).alias("y"), (w * F.col(p)).alias("w")), F.struct(F.lit(0.0).alias("y"), (w * (1 - F.col(p))).alias("w")))
    return df.withColumn("_s", F.explode(pair)).withColumn("y", F.col("_s.y")).withColumn("weight", F.col("_s.w")).drop("_s").where("weight > 0")


def platt(preds: DataFrame, fit_rows: str, *, label: str = "y_true", score: str = "score", out: str = "calibrated") -> DataFrame:
    """A logistic curve over the score, fitted on the rows of `fit_rows`."""
    vec = VectorAssembler(inputCols=[score], outputCol="_f").transform(preds)
    return _scored(LogisticRegression(featuresCol="_f", labelCol=label, maxIter=100).fit(vec.where(fit_rows)), vec, out).drop("_f")


def isotonic(preds: DataFrame, fit_rows: str, *, label: str = "y_true", score: str = "score", out: str = "calibrated") -> DataFrame:
    rows = preds.withColumn("_y", F.col(label).cast("double")).withColumn("_w", F.lit(1.0))
    model = IsotonicRegression(featuresCol=score, labelCol="_y", weightCol="_w").fit(rows.where(fit_rows))
    return model.transform(rows).withColumn(out, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction", "_y", "_w")


def temperature(preds: DataFrame, *, label: str = "y_true", score: str = "score", steps: int = 61) -> DataFrame:
    """(temperature, nll): the T in [1e-3, 1e3] of least mean loss of sigmoid(logit / T), on a log grid that one
    aggregate pass measures, refined once around the best."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = preds.select(F.ln(p / (1 - p)).alias("z"), F.col(label).cast("double").alias("y"))

    def losses(grid):
        def nll(t):
            x = F.col("z") / float(t)
            return F.avg(F.greatest(x, F.lit(0.0)) - x * F.col("y") + F.log1p(F.exp(-F.abs(x))))
        return rows.agg(*(nll(t).alias(f"l{i}") for i, t in enumerate(grid))).first()

    grid = np.logspace(-3, 3, steps)
    best = int(np.argmin(losses(grid)))
    fine = np.logspace(np.log10(grid[max(0, best - 1)]), np.log10(grid[min(steps - 1, best + 1)]), steps)
    got = losses(fine)
    k = int(np.argmin(got))
    return preds.sparkSession.createDataFrame([(float(fine[k]), float(got[k]))], "temperature double, nll double")


# ------------------------------------------------------------------ regimes


def _passes(x: np.ndarray, there: np.ndarray, start: np.ndarray, trans: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple:
    """Filtered and smoothed state probabilities (sequences x steps x 2) and expected transitions of each sequence, for
    sequences x of features, padded behind their ends; `there` marks the steps that are none of the padding."""
    log_b = np.stack([-0.5 * (((x - mean[k]) ** 2) / var[k] + np.log(2 * np.pi * var[k])).sum(2) for k in (0, 1)], 2)
    b = np.exp(log_b - log_b.max(2, keepdims=True))
    f, scale = np.zeros_like(b), np.ones(b.shape[:2])
    prior = np.broadcast_to(start, (len(x), 2))
    for t in range(x.shape[1]):
        a = prior * b[:, t]
        scale[:, t] = np.maximum(a.sum(1), 1e-300)
        f[:, t] = a / scale[:, t, None]
        prior = f[:, t] @ trans
    g, xi, back = np.zeros_like(b), np.zeros((len(x), 2, 2)), np.ones((len(x), 2))
    for t in range(x.shape[1] - 1, -1, -1):
        on = there[:, t, None]
        g[:, t] = np.where(on, f[:, t] * back, 0.0)
        if t:
            e = b[:, t] * back / scale[:, t, None]
            xi += np.where(on[:, :, None], f[:, t - 1, :, None] * trans * e[:, None, :], 0.0)
            back = np.where(on, e @ trans.T, back)
    return f, g / np.maximum(g.sum(2, keepdims=True), 1e-300), xi


STATS = ["s0", "s1", *(f"x{i}{j}" for i in (0, 1) for j in (0, 1)), *(f"{m}{i}{j}" for m in ("a", "q") for i in (0, 1) for j in (0, 1)), "g0", "g1"]
PADDED = 256  # tickers in a padded array


def returns_by_ticker(bar: DataFrame) -> DataFrame:
    """(ticker, date, r): a row a ticker with its dates and log returns of closes in order, written once. Prices without a
    logarithm give none."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = bar.select("ticker", "date", F.ln(F.try_divide("close", F.lag("close").over(w))).alias("r")).where("r is not null")
    lines = r.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "r"))).alias("b"))
    return written(lines.select("ticker", F.col("b.date").alias("date"), F.col("b.r").alias("r")))


def _padded(r: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Features [r, abs(r)] of up to PADDED lines as one array, and which of its places are there."""
    for i in range(0, len(r), PADDED):
        part = r[i : i + PADDED]
        n = np.array([len(x) for x in part])
        there = np.arange(n.max())[None, :] < n[:, None]
        x = np.zeros((len(part), n.max(), 2))
        x[there, 0] = np.concatenate(part)
        x[:, :, 1] = np.abs(x[:, :, 0])
        yield slice(i, i + len(part)), x, there


def _starts(lines: DataFrame, spans: list[tuple[int, str | None, str | None]]) -> dict[int, dict]:
    """Parameters to begin with, for each span of dates: calm and wild days, split at the median of abs(r)."""
    spark = lines.sparkSession
    table = F.broadcast(spark.createDataFrame(spans, "span int, lo string, hi string"))
    inside = (F.col("lo").isNull() | (F.col("date") >= F.col("lo").cast("date"))) & (F.col("hi").isNull() | (F.col("date") < F.col("hi").cast("date")))
    rows = lines.select(F.explode(F.arrays_zip("date", "r")).alias("x")).select("x.date", "x.r").join(table, inside).select("span", "r")
    medians = {r.span: r.m for r in rows.groupBy("span").agg(F.percentile_approx(F.abs("r"), 0.5).alias("m")).collect()}
    if not medians:
        return {}
    med = F.broadcast(spark.createDataFrame(list(medians.items()), "span int, med double"))
    sides = rows.join(med, "span").groupBy("span", (F.abs("r") > F.col("med")).alias("wild")).agg(F.avg("r").alias("m"), F.avg(F.abs("r")).alias("a"), F.var_pop("r").alias("v"), F.var_pop(F.abs("r")).alias("w"))
    g = {(r.span, r.wild): r for r in sides.collect()}
    out = {}
    for k in medians:
        of = lambda wild, *names, k=k: [getattr(g[k, wild], n) if (k, wild) in g else 0.0 for n in names]
        out[k] = {"start": np.array([0.5, 0.5]), "trans": np.array([[0.95, 0.05], [0.05, 0.95]]), "mean": np.array([of(w, "m", "a") for w in (False, True)]), "var": np.maximum(np.array([of(w, "v", "w") for w in (False, True)]), 1e-8)}
    return out


def _after_pass(s: np.ndarray, old: dict) -> dict:
    """The parameters that sums of a pass give; a state that no step is in keeps its old ones."""
    g = s[14:16][:, None]
    mean = np.where(g > 0, s[6:10].reshape(2, 2) / np.maximum(g, 1e-300), old["mean"])
    var = np.where(g > 0, s[10:14].reshape(2, 2) / np.maximum(g, 1e-300) - mean**2, old["var"])
    trans = s[2:6].reshape(2, 2)
    out = trans.sum(1, keepdims=True)
    return {"start": s[:2] / s[:2].sum(), "trans": np.where(out > 0, trans / np.maximum(out, 1e-300), old["trans"]), "mean": mean, "var": np.maximum(var, 1e-8)}


def fit_regimes(lines: DataFrame, cutoffs: list[str | None], *, since: str | None = None, iterations: int = 5, least: int = 50) -> list[dict | None]:
    """Parameters of a two-state Gaussian model of [r, abs(r)] for each cut-off (a date as text; None: no end), fitted by EM on
    the returns of [since, cut-off) of the tickers that have `least` of them there; None where none has.

    lines are returns_by_ticker's. All cut-offs are fitted together: each iteration is one pass over the lines, in which a
    batch of tickers is one padded array a cut-off, and Spark adds up 16 numbers for each.
    """
    lo = np.datetime64(since) if since else None
    spans = [(k, since, c) for k, c in enumerate(cutoffs)]
    par = _starts(lines, spans)

    def stats_of(par):
        def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                dates = [np.array(d, "datetime64[D]") for d in df.date]
                values = [np.array(r, float) for r in df.r]
                for k, p in par.items():
                    first = [0 if lo is None else int(np.searchsorted(d, lo)) for d in dates]
                    last = [len(d) if cutoffs[k] is None else int(np.searchsorted(d, np.datetime64(cutoffs[k]))) for d in dates]
                    own = [v[a:b] for v, a, b in zip(values, first, last, strict=True) if b - a >= least]
                    for _, x, there in _padded(own):
                        _, g, xi = _passes(x, there, **p)
                        row = [k, *g[:, 0].sum(0), *xi.sum(0).ravel(), *np.einsum("btk,btf->kf", g, x).ravel(), *np.einsum("btk,btf->kf", g, x**2).ravel(), *g.sum((0, 1))]
                        yield pd.DataFrame([row], columns=["span", *STATS])

        return stats

    fitted: set[int] = set()
    for _ in range(iterations if par else 0):
        rows = lines.mapInPandas(stats_of(par), "span int, " + ", ".join(f"{c} double" for c in STATS)).groupBy("span").agg(*(F.sum(c).alias(c) for c in STATS)).collect()
        fitted = {r.span for r in rows}
        par = {r.span: _after_pass(np.array([r[c] for c in STATS], float), par[r.span]) for r in rows}
        if not rows:
            break
    return [par[k] if k in fitted else None for k in range(len(cutoffs))]


def regimes(bar: DataFrame, *, cutoffs: list[str] | None = None, since: str | None = None, iterations: int = 5, least: int = 50, smoothed: bool = False) -> DataFrame:
    """(ticker, date, p_trend): probability of the state of higher mean return in a two-state Gaussian model of
    [r, abs(r)], r the log return of closes.

    cutoffs: dates (as text) at which the model is fitted anew on the returns of [since, cut-off). Bars before the second
    cut-off use the first fit, those from a cut-off on the latest one made by then; each probability is filtered forward
    over all of its ticker's returns up to its bar. So no bar from a cut-off on has an influence on any probability
    before it: a value depends on its own bar and earlier ones, and on bars before the first cut-off. A date before the
    first cut-off sees parameters of that whole span, as rows do that a model is trained on.

    Without cutoffs the model is fitted on all bars, so parameters know later ones; `smoothed` probabilities know them in
    any case, and can't be had with cutoffs. Tickers with fewer than `least` returns in a span don't count in its fit; all
    tickers get probabilities. A span without any fit gives no rows.
    """
    if cutoffs and smoothed:
        raise ValueError("smoothed probabilities know later bars")
    lines = returns_by_ticker(bar)
    ends: list[str | None] = sorted(cutoffs) if cutoffs else [None]
    found = fit_regimes(lines, ends, since=since, iterations=iterations, least=least)
    # From where each fit is used: the first from the beginning, the others from their own cut-off.
    use = [(None if k == 0 else np.datetime64(ends[k]), np.datetime64(ends[k + 1]) if k + 1 < len(ends) else None, p) for k, p in enumerate(found)]

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            dates = [np.array(d, "datetime64[D]") for d in df.date]
            values = [np.array(r, float) for r in df.r]
            names = df.ticker.to_numpy()
            for lo, hi, p in use:
                if p is None:
                    continue
                up = int(np.argmax(p["mean"][:, 0]))
                last = [len(d) if hi is None else int(np.searchsorted(d, hi)) for d in dates]
                first = [0 if lo is None else int(np.searchsorted(d, lo)) for d in dates]
                some = [i for i in range(len(dates)) if last[i] > first[i]]
                for at, x, there in _padded([values[i][: last[i]] for i in some]):
                    f, g, _ = _passes(x, there, **p)
                    for j, i in enumerate(some[at]):
                        part = slice(first[i], last[i])
                        yield pd.DataFrame({"ticker": names[i], "date": dates[i][part].astype(object), "p_trend": (g if smoothed else f)[j, part, up]})

    return lines.mapInPandas(infer, "ticker string, date date, p_trend double")


def with_regime(rows: DataFrame, regime: DataFrame, *, asof: str = "asof_date", out: str = "p_regime", ranges: int | None = None) -> DataFrame:
    """rows(ticker, <asof>, ...) with the probability of the last regime row strictly before <asof>: the decision is made at
    the open, before its own bar is known."""
    seen = regime.select("ticker", "date", F.col("p_trend").alias(out))
    return asof_join(rows, seen, ["ticker"], asof, "date", [out], ranges=ranges)
