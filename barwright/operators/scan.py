"""Exponential means over whole histories as a scan: chunks of a line are folded apart and shifted by the ones before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import place_in
from .asof import order_number, time_cuts

RULES = ("keep", "hide", "reset", "decay")


def _steps(values: list[float], a: float, rule: str, y: float | None, gap: int) -> tuple[list[float], float | None, int]:
    """The mean at each place of a line (NaN: none), and the state behind it: the mean, and the missing values since its
    last update."""
    out, nan = [], float("nan")
    for v in values:
        if v != v:
            gap += 1
            if rule == "reset":
                y = None
            out.append(y if rule in ("keep", "decay") and y is not None else nan)
            continue
        if y is None:
            y = v
        elif rule == "decay" and gap:
            old = (1 - a) ** (gap + 1)
            y = (old * y + a * v) / (old + a)
        else:
            y = a * v + (1 - a) * y
        gap = 0
        out.append(y)
    return out, y, gap


def _summary(values: list[float], a: float, rule: str) -> dict:
    """What a chunk does to the state before it: `lead` missing values, the first value, and the affine map (grow, add) from
    the mean behind that value to the one at the chunk's end; `gap` missing values stand at its end."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return {"lead": len(values), "first": None, "grow": None, "add": None, "gap": len(values), "lost": rule == "reset"}
    rest = values[known[0] + 1 :]
    low, one = (_steps(rest, a, rule, y, 0) for y in (0.0, 1.0))
    lost = low[1] is None
    return {"lead": int(known[0]), "first": values[known[0]], "grow": None if lost else one[1] - low[1], "add": low[1], "gap": low[2], "lost": lost}


def ema_scan(df: DataFrame, by: list[str], order: str, value: str, span: int, *, out: str = "ema", missing: str = "keep", ranges: int | None = None) -> DataFrame:
    """df with the exponential mean of `value` (weights 2 / (span + 1), seeded with the first value) along each key's rows in
    order; rows of one time follow their values. A line may have any length: it is cut to chunks by spans of `order`.

    missing: what a NULL or NaN does. `keep` and `hide` leave the mean as it is, shown or not at that row; `reset` shows
    none and starts anew behind; `decay` shows the mean and lets it lose weight, as if it had stood one step for each
    missing value. Rows with a null key or order get no mean.

    Two passes: each chunk becomes an affine map of the mean before it; maps of a key, a row for each chunk, are composed
    in order; the chunks are folded again from the means that they give.
    """
    if missing not in RULES:
        raise ValueError(f"missing must be one of {RULES}")
    if out in df.columns:
        raise ValueError(f"there is a column {out}")
    a = 2.0 / (span + 1)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), order_number(df, order).alias("_at"), F.col(value).cast("double").alias("_x"), F.struct(*df.columns).alias("_row"))
    whole = F.col("_at").isNotNull()
    for k in keys:
        whole &= F.col(k).isNotNull()
    rest = rows.where(~whole).select("_row.*", F.lit(None).cast("double").alias(out))
    rows = rows.where(whole)
    rows = rows.withColumn("_span", place_in(time_cuts(rows, "_at", ranges), F.col("_at"), "double"))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["_at", "_x"], kind="stable")

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _summary(ordered(pdf)["_x"].tolist(), a, missing)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "_span": pdf["_span"].iloc[0], **s}])

    maps = rows.select(*keys, "_span", "_at", "_x").groupBy(*keys, "_span").applyInPandas(summed, f"{kinds}, _span int, lead long, first double, grow double, add double, gap long, lost boolean")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state before each chunk of a key: a row a chunk."""
        pdf, y, gap, states = pdf.sort_values("_span"), None, 0, []
        for r in pdf.itertuples():
            states.append((y, gap))
            if pd.isna(r.first):
                gap += int(r.gap)
                y = None if r.lost else y
                continue
            lead = _steps([float("nan")] * int(r.lead) + [float(r.first)], a, missing, y, gap)
            y = None if r.lost else float(r.grow) * lead[1] + float(r.add)
            gap = int(r.gap)
        out = pdf[[*keys, "_span"]].copy()
        out["_y"], out["_gap"] = [s[0] for s in states], [s[1] for s in states]
        return out

    states = maps.groupBy(*keys).applyInPandas(composed, f"{kinds}, _span int, _y double, _gap long")
    row_type = rows.schema["_row"].dataType.simpleString()

    def folded(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = ordered(left)
        y, gap = (None, 0) if not len(right) else (right["_y"].iloc[0], int(right["_gap"].iloc[0]))
        found, _, _ = _steps(left["_x"].tolist(), a, missing, None if y is None or y != y else float(y), gap)
        return pd.DataFrame({"_row": left["_row"], out: found})

    done = rows.groupBy(*keys, "_span").cogroup(states.groupBy(*keys, "_span")).applyInPandas(folded, f"_row {row_type}, {out} double")
    mean = F.when(~F.isnan(out), F.col(out)).alias(out)
    return done.select("_row.*", mean).unionByName(rest)
