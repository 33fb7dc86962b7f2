"""Ranking and classification metrics of predictions(sample_id, setup, y_true, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_of
from ..functions.scalars import ratio


def _keys(by: str | None) -> list[str]:
    return [by] if by else []


def at_threshold(preds: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """Confusion counts, precision, recall and F1 of score >= threshold; 0 where undefined."""
    hit, pos = F.col("score") >= threshold, F.col("y_true") == 1
    g = preds.groupBy(*_keys(by)).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = g.withColumn("precision", zero(ratio("tp", F.col("tp") + F.col("fp")))).withColumn("recall", zero(ratio("tp", F.col("tp") + F.col("fn"))))
    return g.withColumn("f1", zero(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def _by_score(preds: DataFrame, by: str | None) -> DataFrame:
    """Positives and negatives of each distinct score: what the ranking metrics need, reduced before any ordering."""
    return preds.groupBy(*_keys(by), "score").agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("q"))


def _shifted(rows: DataFrame, keys: list[str], part: Column, order: list[Column], sums: dict[str, Column], inclusive: bool) -> DataFrame:
    """rows with running sums in an order, in two steps, so that no task holds all rows: the ranges `part` (which follow
    the order) are summed apart and shifted by the sums of the ranges before, a small table."""
    rows = rows.withColumn("_p", part)
    totals = rows.groupBy(*keys, "_p").agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_p", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    line = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({k: F.coalesce(F.sum(c).over(line), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(totals), [*keys, "_p"])
    return rows.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_p", *(f"_b_{k}" for k in sums))


def auroc(preds: DataFrame, by: str | None = None) -> DataFrame:
    """Area under the ROC curve (ties count half) as a Mann-Whitney statistic; NULL if a class is empty."""
    rows = _shifted(_by_score(preds, by), _keys(by), range_of(preds, F.col("score")), [F.col("score")], {"below": F.col("q")}, False)
    g = rows.groupBy(*_keys(by)).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return g.select(*_keys(by), ratio("u", (F.col("p") * F.col("q")).cast("double")).alias("auroc"))


def _running(preds: DataFrame, by: str | None) -> DataFrame:
    """preds with rank and hits (positives so far) in the order of score, highest first."""
    down = -range_of(preds, F.col("score"))
    return _shifted(preds, _keys(by), down, [F.desc("score"), F.col("sample_id")], {"rank": F.lit(1), "hits": (F.col("y_true") == 1).cast("int")}, True)


def auprc(preds: DataFrame, by: str | None = None) -> DataFrame:
    """Average precision in the order of score (highest first), ties in order of sample_id; NULL without positives."""
    rows = _running(preds, by)
    g = rows.groupBy(*_keys(by)).agg(F.sum(F.when(F.col("y_true") == 1, F.col("hits") / F.col("rank"))).alias("s"), F.count_if(F.col("y_true") == 1).alias("p"))
    return g.select(*_keys(by), ratio("s", "p").alias("auprc"))


def at_k(preds: DataFrame, ks: tuple[int, ...] = (25, 50, 100), by: str | None = None) -> DataFrame:
    """Precision and recall among the k highest scores (k at most the number of rows); recall is NULL without positives."""
    w = Window.partitionBy(*_keys(by)).orderBy(F.desc("score"), "sample_id")
    most = max(ks)
    totals = preds.groupBy(*_keys(by)).agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 1).alias("p"))
    if not by:
        preds = preds.orderBy(F.desc("score"), "sample_id").limit(most)
    top = preds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    rows = top.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("rank <= k").groupBy(*_keys(by), "k").agg(F.count_if(F.col("y_true") == 1).alias("tp"))
    out = rows.join(F.broadcast(totals), by) if by else rows.crossJoin(F.broadcast(totals))
    return out.select(*_keys(by), "k", F.least("k", "n").cast("int").alias("k_eff"), (F.col("tp") / F.least("k", "n")).alias("precision_at_k"), ratio("tp", "p").alias("recall_at_k"))


def report(preds: DataFrame, threshold: float = 0.5, ks: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """One row over all and one for each setup: counts, mean and deviation of scores, AUROC, AUPRC, the threshold's, and
    precision and recall among the k highest scores."""
    both = preds.unionByName(preds.withColumn("setup", F.lit("all")))
    base = both.groupBy("setup").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 1).alias("n_pos"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    one = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c[:-1]}{k}")
    top = at_k(both, ks, "setup").groupBy("setup").agg(*(one(k, c) for k in ks for c in ("precision_at_k", "recall_at_k")))
    out = base
    for part in (auroc(both, "setup"), auprc(both, "setup"), at_threshold(both, threshold, "setup").select("setup", "precision", "recall", "f1"), top):
        out = out.join(part, "setup")
    return out


def write_report(preds: DataFrame, folder: str, **options) -> None:
    """predictions.parquet, metrics_by_setup.parquet (a row a setup) and metrics.json (the row over all) in a folder."""
    preds.write.mode("overwrite").parquet(f"{folder}/predictions.parquet")
    report(preds, **options).write.mode("overwrite").parquet(f"{folder}/all.parquet")
    found = preds.sparkSession.read.parquet(f"{folder}/all.parquet")
    found.where("setup <> 'all'").write.mode("overwrite").parquet(f"{folder}/metrics_by_setup.parquet")
    found.where("setup = 'all'").drop("setup").coalesce(1).write.mode("overwrite").json(f"{folder}/metrics.json")


def suggest(preds: DataFrame, n_uncertain: int, n_top: int) -> DataFrame:
    """Rows to label next: the n least certain, then the n highest, each sample once with its first reason."""
    gap = F.abs(F.col("score") - 0.5)
    a = preds.orderBy(gap, "score", "sample_id").limit(n_uncertain).withColumn("reason", F.lit("uncertain")).withColumn("_r", F.lit(0))
    b = preds.orderBy(F.desc("score"), "sample_id").limit(n_top).withColumn("reason", F.lit("top")).withColumn("_r", F.lit(1))
    return a.unionByName(b).groupBy("sample_id").agg(F.min_by(F.struct("score", "reason"), "_r").alias("x")).select("sample_id", "x.score", "x.reason")
