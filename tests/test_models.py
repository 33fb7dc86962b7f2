"""Models, calibration, embeddings and augmentation against brute force and against cases whose answer is known."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import embed, models
from barwright.operators import window_features as X


def fitted_logistic(x, y, w, ridge):
    """Newton's method on the weighted mean loss with an L2 penalty on weights of standardised features."""
    sd = x.std(0, ddof=1)
    z = np.hstack([x / sd, np.ones((len(x), 1))])
    b, pen = np.zeros(z.shape[1]), np.array([ridge] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z.T * (w * p * (1 - p) / w.sum())) @ z + np.diag(pen), z.T @ (w * (p - y)) / w.sum() + pen * b)
    return 1 / (1 + np.exp(-z @ b))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1.0, 3.0]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=300) > 0.4).astype(float)
    return x, y


def test_logistic_against_newton(spark, points):
    x, y = points
    rows = [(i, float(a), float(b), float(c), "train") for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = models.prepared(spark.createDataFrame(rows, "i int, a double, b double, y double, split string"), ["a", "b"])
    got = [r.score for r in models.logistic(df.withColumn("weight", F.lit(1.0)), ridge=0.05).orderBy("i").collect()]
    assert got == pytest.approx(fitted_logistic(x, y, np.ones(300), 0.05), abs=2e-3)


def test_balanced_weights_and_soft_rows(spark):
    df = models.balanced(spark.createDataFrame([(1.0,), (0.0,), (0.0,), (0.0,)], "y double"))
    assert sorted(r.weight for r in df.collect()) == pytest.approx([4 / 6, 4 / 6, 4 / 6, 2.0])
    soft = models.soft_rows(spark.createDataFrame([(1, 0.25), (2, 1.0)], "k int, p double"), "p").collect()
    assert sorted((r.k, r.y, r.weight) for r in soft) == [(1, 0.0, 0.75), (1, 1.0, 0.25), (2, 1.0, 1.0)]


def test_boosted_trees_learn_a_square(spark):
    """A class that no line parts: inside a square or not."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (600, 2))
    y = (np.abs(x).max(1) < 0.6).astype(float)
    rows = [(float(a), float(b), float(c), ("train", "val", "test")[i % 3], i % 3 == 1, 1.0) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = models.prepared(spark.createDataFrame(rows, "a double, b double, y double, split string, is_val boolean, weight double"), ["a", "b"])
    test = models.boosted(df).where("split = 'test'").collect()
    assert np.mean([(r.score >= 0.5) == (r.y == 1) for r in test]) >= 0.93


def pooled_averages(score, y):
    """Isotonic regression by pooling neighbours, equal scores first."""
    blocks = []
    for s in sorted(set(score)):
        own = [v for u, v in zip(score, y, strict=True) if u == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, n, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2] + at]
    return {s: a / n for a, n, at in blocks for s in at}


def test_calibration_against_brute_force(spark):
    rng = np.random.default_rng(8)
    score = np.round(rng.random(200), 2)
    y = (rng.random(200) < score**2).astype(int)
    p = spark.createDataFrame([(i, float(s), int(v)) for i, (s, v) in enumerate(zip(score, y, strict=True))], "i int, score double, y_true int")
    want = pooled_averages(score.tolist(), y.tolist())
    assert all(r.calibrated == pytest.approx(want[r.score], abs=1e-9) for r in models.isotonic(p, "true").collect())
    line = [r.calibrated for r in models.platt(p, "true").orderBy("i").collect()]
    assert line == pytest.approx(fitted_logistic(score[:, None], y, np.ones(200), 0.0), abs=2e-3)
    z = np.log(np.clip(score, 1e-6, 1 - 1e-6) / (1 - np.clip(score, 1e-6, 1 - 1e-6)))
    loss = lambda t: float(np.mean(np.maximum(z / t, 0) - z / t * y + np.log1p(np.exp(-np.abs(z / t)))))
    best = min((loss(t), t) for t in np.logspace(-1, 1, 4001))
    got = models.temperature(p).first()
    assert got.nll == pytest.approx(best[0], abs=1e-5) and got.temperature == pytest.approx(best[1], rel=0.02)


def test_forward_backward_against_all_paths():
    """Probabilities of states and steps, summed over all 2^n paths of two sequences of different lengths."""
    rng = np.random.default_rng(1)
    start, trans = np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.25, 0.75]])
    mean, var = np.array([[0.5, 0.6], [-0.3, 0.9]]), np.array([[0.4, 0.3], [0.8, 0.5]])
    seqs = [rng.normal(size=(n, 2)) for n in (6, 4)]
    there = np.arange(6)[None, :] < np.array([[6], [4]])
    x = np.zeros((2, 6, 2))
    for k, s in enumerate(seqs):
        x[k, : len(s)] = s
    f, g, xi = models._passes(x, there, start, trans, mean, var)
    density = lambda v, k: math.exp(-0.5 * float((((v - mean[k]) ** 2) / var[k] + np.log(2 * np.pi * var[k])).sum()))
    for k, s in enumerate(seqs):
        for upto in range(1, len(s) + 1):
            total, last = 0.0, np.zeros(2)
            state, steps = np.zeros((upto, 2)), np.zeros((2, 2))
            for path in itertools.product((0, 1), repeat=upto):
                p = start[path[0]] * math.prod(trans[a, b] for a, b in itertools.pairwise(path)) * math.prod(density(v, q) for v, q in zip(s, path, strict=False))
                total += p
                last[path[-1]] += p
                for t, q in enumerate(path):
                    state[t, q] += p
                for a, b in itertools.pairwise(path):
                    steps[a, b] += p
            assert f[k, upto - 1] == pytest.approx(last / total)
        assert g[k, : len(s)] == pytest.approx(state / total) and xi[k] == pytest.approx(steps / total)
    assert not g[1, 4:].any()


def test_regimes_of_a_calm_rise_and_a_wild_fall(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in ("UP", "DOWN"):
        close, d = 100.0, dt.date(2021, 3, 1)
        for i in range(160):
            wild = (i // 40) % 2 == (t == "UP")
            close *= math.exp(rng.normal(-0.01, 0.03) if wild else rng.normal(0.004, 0.004))
            rows.append((t, d + dt.timedelta(days=i), close, bool(wild)))
    rows += [("SHORT", dt.date(2021, 3, 1 + i), 1.0, False) for i in range(3)]
    bar = spark.createDataFrame(rows, "ticker string, date date, close double, wild boolean")
    for smoothed, least in ((False, 0.88), (True, 0.95)):  # a filter knows a change only some days behind it
        got = models.regimes(bar, iterations=8, smoothed=smoothed).join(bar, ["ticker", "date"]).collect()
        assert len(got) == 320 and np.mean([(r.p_trend < 0.5) == r.wild for r in got if r.ticker != "SHORT"]) >= least
    assert models.regimes(bar.limit(0)).count() == 0


def test_pooled_embedding_against_numpy(spark):
    rng = np.random.default_rng(6)
    curves = [[[None if v > 1.4 else float(v) for v in rng.normal(size=9)] for _ in range(2)] for _ in range(4)] + [[[None] * 9, [1.0] * 9]]
    rows = [(f"s{i}", float(i), None if i == 2 else 0.5, c) for i, c in enumerate(curves)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c array<array<double>>")

    def resampled(y, n):
        known = [i for i, v in enumerate(y) if v is not None]
        if not known:
            return [0.0] * n
        filled = [y[max((k for k in known if k <= i), default=known[0])] for i in range(len(y))]
        out = []
        for j in range(n):
            at = j * (len(y) - 1) / (n - 1)
            i = min(int(at), len(y) - 2)
            out.append(filled[i] + (at - i) * (filled[i + 1] - filled[i]))
        return out

    for dims in (128, 5):
        got = {r.k: r.embedding for r in embed.encode(df, "k", ["a", "b"], "c", length=4, dims=dims, seed=9).collect()}
        for k, a, b, c in rows:
            v = np.array([a, b or 0.0, *resampled(c[0], 4), *resampled(c[1], 4)])
            if dims < 10:
                v = v @ (np.random.default_rng(9).standard_normal((10, dims)) / np.sqrt(dims))
            assert got[k] == pytest.approx(v / max(np.linalg.norm(v), 1e-12), abs=1e-5)


def test_augmentation(spark):
    rows = spark.createDataFrame([(f"s{i}", t, float(i), float(t) if t % 5 else None) for i in range(400) for t in range(20)], "sample_id string, t int, a double, b double")
    plain = X.augment(rows, ("a", "b"), crops=(99,), modes=()).collect()
    assert len(plain) == 8000 and all(r.crop == 20 and not r.masked_a and r.a == float(r.sample_id[1:]) and r.b == (float(r.t) if r.t % 5 else None) for r in plain)
    out = X.augment(rows, ("a", "b"), crops=(8, 12), sigma=0.1, censor=0.4, modes=("both",), mask_time=0.2, mask_feature=0.3).collect()
    crop = {r.crop for r in out}
    assert len(crop) == 1 and crop <= {8, 12} and len(out) == 400 * min(crop) and {r.t for r in out} == set(range(min(crop)))
    noise = np.array([r.a - float(r.sample_id[1:]) for r in out if r.a is not None])
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 0.1) < 0.01
    last = [r for r in out if r.t == r.crop - 1]
    assert 0.3 < np.mean([r.a is None for r in last]) < 0.5 and all(r.a is not None for r in out if r.t < r.crop - 1)
    assert not any((r.masked_a and r.a is None) or (r.masked_b and r.b is None) for r in out)
    assert abs(np.mean([r.masked_a for r in out if r.a is not None]) - (1 - 0.8 * 0.7)) < 0.04
    timed = X.augment(rows, ("a", "b"), crops=(12,), modes=("time",)).where("a is not null and b is not null").collect()
    assert all(r.masked_a == r.masked_b for r in timed) and any(r.masked_a for r in timed)
    drops = {seed: X.augment(rows, ("a", "b"), seed=seed, crops=(), drop=0.5).agg(F.count("a"), F.count("b")).first() for seed in range(6)}
    assert {n for r in drops.values() for n in r} == {0, 8000, 6400}
