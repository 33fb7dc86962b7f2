"""Whole jobs over bars: the training table, scans of a day's tickers, and ranking of candidates by a model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sample_key
from ..sources.shared import written
from . import stages
from .embed import window_embeddings
from .models import with_regime
from .normalize import zscore
from .window_features import TabularSpec, tabular
from .windows import VALUES, windowed

REGIME = "p_regime"


def feature_table(samples: DataFrame, sessions: DataFrame, bar: DataFrame, *, regime: DataFrame | None = None, spec: TabularSpec | None = None) -> tuple[DataFrame, list[str]]:
    """(sample_id, all tabular features) of each sample with a whole window, and the features' names. regime(ticker, date,
    p_trend) adds p_regime: the probability of the last bar before the as-of date."""
    s = spec or TabularSpec()
    rows = tabular(windowed(samples, sessions, bar, s.size), s)
    names = [c for c in rows.columns if c != "sample_id"]
    if regime is not None:
        at = with_regime(samples.select("sample_id", "ticker", "asof_date"), regime, out=REGIME)
        rows, names = rows.join(at.select("sample_id", REGIME), "sample_id"), [*names, REGIME]
    return rows, names


def training_table(samples: DataFrame, sessions: DataFrame, bar: DataFrame, *, regime: DataFrame | None = None, spec: TabularSpec | None = None, shares: tuple[float, float] = (0.6, 0.8)) -> tuple[DataFrame, list[str]]:
    """The feature table with y (label as 0 or 1), asof_date and split: train up to the date below which the first share of
    samples lies, val up to the second one's, test behind. Whole dates go to one split. Written once."""
    rows, names = feature_table(samples, sessions, bar, regime=regime, spec=spec)
    day = F.unix_date("asof_date")
    cuts = samples.agg(F.percentile_approx(day, list(shares)).alias("_q"))
    rows = rows.join(samples.select("sample_id", F.col("label").cast("double").alias("y"), "asof_date"), "sample_id").crossJoin(F.broadcast(cuts))
    split = F.when(day <= F.get("_q", F.lit(0)), "train").when(day <= F.get("_q", F.lit(1)), "val").otherwise("test")
    return written(rows.withColumn("split", split).drop("_q")), names


def scan(tickers: DataFrame, sessions: DataFrame, bar: DataFrame, model: PipelineModel, *, asof: str | None = None, setup: str = "scan", regime: DataFrame | None = None, spec: TabularSpec | None = None) -> DataFrame:
    """(sample_id, ticker, asof_date, setup, score, calibrated, rank) of every ticker with a whole window at one session (the
    latest by default), scored by a fitted pipeline, the highest score first, ties in order of ticker.

    Only the open of that session is known to the features. Sessions are a calendar; an `asof` that is none gives no rows.
    """
    day = sessions.agg(F.max("date").alias("asof_date")) if asof is None else sessions.where(F.col("date") == F.lit(asof).cast("date")).select(F.col("date").alias("asof_date"))
    samples = tickers.select("ticker").where("ticker is not null").distinct().crossJoin(F.broadcast(day))  # one row
    samples = samples.select(sample_key("ticker", "asof_date", F.lit(setup)).alias("sample_id"), "ticker", "asof_date", F.lit(setup).alias("setup"), F.lit(None).cast("boolean").alias("label"))
    rows, _ = feature_table(samples, sessions, bar, regime=regime, spec=spec)
    found = stages.scored(model, rows, ["sample_id"]).join(samples.drop("label"), "sample_id")
    return ranked_by_score(found, ["ticker"])


def ranked_by_score(rows: DataFrame, ties: list[str]) -> DataFrame:
    """rows with their rank by score, the highest first; in two steps, so that no task holds all rows."""
    from .labels import ranked

    return ranked(rows.withColumn("_down", -F.col("score")), [F.col("_down"), *(F.col(c) for c in ties)], kind="double").drop("_down")


def candidate_windows(candidates: DataFrame, sessions: DataFrame, bar: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Candidates with a sample_id, one row of each (ticker, asof_date, setup), and their windows of `size` rows, in which a
    column `inside` marks the rows of the candidate itself (cand_t_start to cand_t_end from the window's end)."""
    named = candidates.withColumn("sample_id", sample_key("ticker", "asof_date", "setup"))
    rest = [c for c in named.columns if c != "sample_id"]
    named = named.groupBy("sample_id").agg(F.min(F.struct(*rest)).alias("_r")).select("sample_id", "_r.*")
    keys = named.select("sample_id", "ticker", "asof_date", "setup", "label", (F.lit(size - 1) - F.col("cand_end_offset")).alias("_end"), "cand_length")
    rows = windowed(keys, sessions, bar, size, unique=False)
    inside = F.col("t").between(F.col("_end") - F.col("cand_length") + 1, F.col("_end"))
    return named, rows.withColumn("inside", inside).drop("_end", "cand_length")


def embedded_windows(windows: DataFrame, columns: tuple[str, ...] = VALUES, **options) -> DataFrame:
    """(sample_id, embedding) of windows in long form, each value in deviations of its window."""
    return window_embeddings(zscore(windows, columns).select("sample_id", "t", *columns), "sample_id", "t", columns, **options)


def rerank(candidates: DataFrame, sessions: DataFrame, bar: DataFrame, head: PipelineModel, *, size: int = 100) -> DataFrame:
    """Candidates with a whole window of `size` rows, their score by a head on the windows' embeddings, and their rank, the
    highest score first, ties in order of sample_id. Their own columns stay; one of each (ticker, asof_date, setup)."""
    named, rows = candidate_windows(candidates, sessions, bar, size)
    found = head.transform(embedded_windows(rows)).select("sample_id", "score")
    return ranked_by_score(named.join(found, "sample_id"), ["sample_id"])


def reranker(samples: DataFrame, sessions: DataFrame, bar: DataFrame, *, size: int = 100, p: str | None = None) -> PipelineModel:
    """A head fitted on the embeddings of labelled samples' windows: their label, or a soft label in the column p."""
    rows = embedded_windows(windowed(samples, sessions, bar, size))
    soft = F.col(p) if p else F.col("label").cast("double")
    return stages.train_head(written(rows.join(samples.select("sample_id", soft.alias("p")).where("p is not null"), "sample_id")))
