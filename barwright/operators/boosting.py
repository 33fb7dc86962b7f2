"""Gradient boosting on histograms: features are binned once, trees grow leaf by leaf, the best leaf first.

Each pass over the rows is one aggregation: tasks sum gradients by node, feature and bin, Spark adds the tasks' sums, and the
driver, which sees sums of a bounded size only, chooses splits. Of two children the smaller one is counted; the other is the
parent less it. A pass counts for several leaves at once, those of the largest gains, and trees still grow strictly best
leaf first: splits that were counted too early wait, or are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BINS = 64  # of a feature; bin 0 holds missing values


@dataclass
class Tree:
    """Nodes by number: the feature that splits one (-1: a leaf), the last bin that goes left, its children, and its value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, b
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.extend([x, x])
        return a, b

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            own = at[inner]
            at[inner] = np.where(bins[inner, feature[own]] <= cut[own], left[own], right[own])


def margins(trees: list[Tree], base: float, bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), base)
    for t in trees:
        out += np.array(t.value)[t.nodes_of(bins)]
    return out


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins of rows x features: 0 for missing, else 1 more than the cuts that lie below the value."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        known = np.isfinite(x[:, j])
        out[known, j] = 1 + np.searchsorted(np.array(c), x[known, j], side="left")
    return out


def _rows(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    bins = np.frombuffer(b"".join(column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
    return bins, column("y").to_numpy(), column("w").to_numpy(), column("held").to_numpy(zero_copy_only=False)


HIST = "node int, j int, g double, h double, n double"


def _sums(rows: DataFrame, n_features: int, trees: list[Tree], base: float, tree: Tree, nodes: list[int]) -> tuple[dict[int, np.ndarray], float | None]:
    """For each node a histogram (3 x features x BINS: gradients, their slopes, rows) of the rows that aren't held back, and
    the mean loss of the held ones under the trees before; None without held rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((3, n_features * BINS)) for k in nodes}
        loss = np.zeros(2)
        offsets = np.arange(n_features) * BINS
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, w, held = _rows(batch, n_features)
            z = margins(trees, base, bins)
            loss += ((w * (np.logaddexp(0, z) - y * z))[held].sum(), w[held].sum())
            p = 1 / (1 + np.exp(-z))
            at = np.where(held, -1, tree.nodes_of(bins))
            for k in nodes:
                own = np.flatnonzero(at == k)
                places = (bins[own] + offsets).ravel()
                for i, v in enumerate(((p - y) * w, p * (1 - p) * w, np.ones(len(y)))):
                    total[k][i] += np.bincount(places, np.repeat(v[own], n_features), n_features * BINS)
        node, j, values = [-1], [0], [np.array([[loss[0]], [loss[1]], [0.0]])]
        for k, t in total.items():
            used = np.flatnonzero(t[2])
            node += [k] * len(used)
            j += used.tolist()
            values.append(t[:, used])
        g, h, n = np.concatenate(values, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(j, pa.int32()), pa.array(g), pa.array(h), pa.array(n)], ["node", "j", "g", "h", "n"])

    found = rows.mapInArrow(run, HIST).groupBy("node", "j").agg(*(F.sum(c).alias(c) for c in "ghn")).toPandas()
    out = {k: np.zeros((3, n_features * BINS)) for k in nodes}
    for k, part in found[found.node >= 0].groupby("node"):
        out[int(k)][:, part.j.to_numpy()] = part[["g", "h", "n"]].to_numpy().T
    held = found[found.node == -1]
    weight = float(held.h.sum())
    return {k: v.reshape(3, n_features, BINS) for k, v in out.items()}, float(held.g.sum()) / weight if weight else None


def best_split(hist: np.ndarray, ridge: float, least: int) -> tuple[float, int, int, float]:
    """(gain, feature, cut, rows to the left) of the best split of a node; gain 0 if there is none. Ties go to the first
    feature and the lowest cut."""
    g, h, n = (x.cumsum(axis=1) for x in hist)
    all_g, all_h, all_n = (x[:, -1:] for x in (g, h, n))
    score = lambda a, b: a**2 / (b + ridge)
    gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
    gain[(n < least) | (all_n - n < least)] = 0.0
    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[j, b]), int(j), int(b), float(n[j, b])) if gain[j, b] > 1e-12 else (0.0, -1, 0, 0.0)


class LeafwiseBoostingModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Scores rows by stored trees; missing values of a feature are a bin of their own."""

    forest = Param(Params._dummy(), "forest", "cuts, base and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str = "score", forest: str = ""):
        super().__init__()
        self._setDefault(outputCol="score", forest="")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = json.loads(self.getOrDefault("forest"))
        cuts, base, trees = kept["cuts"], kept["base"], [Tree(**t) for t in kept["trees"]]

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            rows = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), len(cuts))
            return pd.Series(1 / (1 + np.exp(-margins(trees, base, binned(rows, cuts)))))

        return df.withColumn(self.getOutputCol(), score(F.array(*(F.col(c).cast("double") for c in self.getInputCols()))))


class LeafwiseBoosting(Estimator, HasInputCols, HasLabelCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits up to `trees` trees of up to `leaves` leaves on the rows for which `held` (SQL) doesn't hold, and keeps those up to
    the least loss of the held ones, stopping after `patience` trees without a better one (without held rows: all).

    Rows with a null label don't count. `weight` is a column of weights (none: 1 each); rows of label 1 count `positive` times
    as much. Cuts of a feature are up to BINS - 2 of its quantiles; a feature without values splits nothing.
    """

    options = Param(Params._dummy(), "options", "of the fit, as JSON", TypeConverters.toString)

    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = "y", outputCol: str = "score", weight: str = "", held: str = "false", trees: int = 20, leaves: int = 15, rate: float = 0.1, ridge: float = 1.0, least: int = 20, positive: float = 1.0, patience: int = 5, at_once: int = 4):
        super().__init__()
        own = {"weight": weight, "held": held, "trees": trees, "leaves": leaves, "rate": rate, "ridge": ridge, "least": least, "positive": positive, "patience": patience, "at_once": at_once}
        self._set(inputCols=inputCols, labelCol=labelCol, outputCol=outputCol, options=json.dumps(own))

    def _fit(self, df: DataFrame) -> LeafwiseBoostingModel:
        o = json.loads(self.getOrDefault("options"))
        columns, label = self.getInputCols(), F.col(self.getLabelCol()).cast("double")
        finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf"))), F.col(c).cast("double"))
        w = (F.col(o["weight"]).cast("double") if o["weight"] else F.lit(1.0)) * F.when(label == 1, float(o["positive"])).otherwise(1.0)
        rows = written(df.where(label.isNotNull()).select(label.alias("y"), w.alias("w"), F.coalesce(F.expr(o["held"]).cast("boolean"), F.lit(False)).alias("held"), *(finite(c).alias(f"x{i}") for i, c in enumerate(columns))))
        points = [i / (BINS - 1) for i in range(1, BINS - 1)]
        found = rows.where("not held").approxQuantile([f"x{i}" for i in range(len(columns))], points, 0.001)
        cuts = [sorted(set(c)) for c in found]
        table = self._binned(rows, cuts)
        sums = table.where("not held").agg(F.sum(F.col("y") * F.col("w")).alias("p"), F.sum("w").alias("n")).first()
        share = min(max((sums.p or 0.0) / sums.n, 1e-6), 1 - 1e-6) if sums.n else 0.5
        base = float(np.log(share / (1 - share)))
        trees, best, since = [], (None, 0), 0
        while len(trees) < o["trees"]:
            tree, loss = self._grown(table, len(columns), trees, base, o)
            if loss is not None and (best[0] is None or loss < best[0]):
                best, since = (loss, len(trees)), 0
            elif loss is not None:
                since += 1
            if (loss is not None and since >= o["patience"]) or len(tree.feature) == 1:
                break
            trees.append(tree)
        if best[0] is not None:
            _, last = _sums(table, len(columns), trees, base, Tree(), [])
            trees = trees if last is not None and last < best[0] else trees[: best[1]]
        kept = {"cuts": cuts, "base": base, "trees": [vars(t) for t in trees]}
        return LeafwiseBoostingModel(inputCols=columns, outputCol=self.getOutputCol(), forest=json.dumps(kept))

    @staticmethod
    def _binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(cuts))], float).T.reshape(batch.num_rows, len(cuts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in binned(x, cuts)], pa.binary())], ["y", "w", "held", "bins"])

        return written(rows.mapInArrow(run, "y double, w double, held boolean, bins binary"))

    @staticmethod
    def _grown(table: DataFrame, n_features: int, trees: list[Tree], base: float, o: dict) -> tuple[Tree, float | None]:
        """The next tree, and the loss of held rows before it. Nodes of `full` are all that were split to be counted; the tree
        takes the best leaf of those known until it has enough, and asks for more where a taken one isn't split yet."""
        full = Tree()
        hist, loss = _sums(table, n_features, trees, base, full, [0])
        split = {0: best_split(hist[0], o["ridge"], o["least"])}

        def taken() -> tuple[list[int], list[int]]:
            """Nodes that the tree splits, in order, and the leaf that must be split before it can go on (or none)."""
            order, front = [], [(-split[0][0], 0)]
            while front and len(order) < o["leaves"] - 1 and front[0][0] < 0:
                node = front[0][1]
                if full.feature[node] < 0:
                    return order, [k for _, k in sorted(front) if full.feature[k] < 0 and split[k][0] > 0]
                heapq.heappop(front)
                order.append(node)
                for k in (full.left[node], full.right[node]):
                    heapq.heappush(front, (-split[k][0], k))
            return order, []

        while True:
            order, want = taken()
            if not want:
                break
            counted = {}
            for node in want[: o["at_once"]]:
                _, feature, cut, left_rows = split[node]
                a, b = full.split(node, feature, cut)
                small = a if 2 * left_rows <= hist[node][2, 0].sum() else b
                counted[small] = (node, a + b - small)
            new, _ = _sums(table, n_features, trees, base, full, list(counted))
            for small, (node, other) in counted.items():
                hist[small], hist[other] = new[small], hist.pop(node) - new[small]
                for k in (small, other):
                    split[k] = best_split(hist[k], o["ridge"], o["least"])
        return _pruned(full, set(order), hist, o), loss


def _pruned(full: Tree, inner: set[int], hist: dict[int, np.ndarray], o: dict) -> Tree:
    """The tree whose inner nodes are the given ones of `full`, with the values of its leaves."""

    def sums(node: int) -> np.ndarray:
        return hist[node][:, 0].sum(axis=1) if full.feature[node] < 0 else sums(full.left[node]) + sums(full.right[node])

    out = Tree()

    def copy(node: int, at: int) -> None:
        if node in inner:
            a, b = out.split(at, full.feature[node], full.cut[node])
            copy(full.left[node], a)
            copy(full.right[node], b)
        else:
            g, h, _ = sums(node)
            out.value[at] = float(-o["rate"] * g / (h + o["ridge"]))

    copy(0, 0)
    return out
