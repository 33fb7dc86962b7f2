"""Operators that deal hot keys and whole tables to many tasks, against brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from barwright.operators import asof, boosting, embed, jobs, models, quantiles, scan, stages, vector_index, weak, windows
from barwright.operators import bars as B

DAY0 = dt.date(2031, 5, 2)


def on(i):
    return DAY0 + dt.timedelta(days=i)


# ------------------------------------------------------------------ as-of join


def last_known(probe, observations, strict, forward, tolerance):
    key, t = probe
    best = None
    for k, u, v in observations:
        if k != key or k is None or t is None or u is None:
            continue
        gap = (u - t if forward else t - u).days
        if gap < 0 or (strict and gap == 0) or (tolerance is not None and gap > tolerance):
            continue
        if best is None or (gap, -v) < (best[0], -best[1]):
            best = (gap, v)
    return None if best is None else best[1]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_with_a_hot_key(spark, strict, forward):
    """Nine tenths of all rows have one key; times repeat on both sides."""
    rng = random.Random(4)
    keys = ["HOT"] * 18 + ["A", None]
    obs = [(rng.choice(keys), rng.choice([on(rng.randrange(90)), on(33)]) if rng.random() > 0.02 else None, rng.random()) for _ in range(300)]
    probes = [(i, rng.choice(keys + ["ALONE"]), on(rng.randrange(-5, 95)) if rng.random() > 0.03 else None) for i in range(400)]
    left = spark.createDataFrame(probes + probes[:3], "i int, k string, at date")
    right = spark.createDataFrame(obs, "name string, seen date, v double")
    for tolerance, ranges in ((None, 13), (2, 5), (None, 1)):
        got = asof.asof_join(left, right.withColumnRenamed("name", "k"), ["k"], "at", "seen", ["v"], strict=strict, forward=forward, tolerance=tolerance, ranges=ranges).collect()
        assert sorted(r.i for r in got) == sorted([p[0] for p in probes] + [0, 1, 2])
        for r in got:
            assert r.v == last_known((r.k, r.at), obs, strict, forward, tolerance)


def test_asof_join_deals_a_key_to_spans(spark):
    rows = spark.range(20_000).select(F.lit("K").alias("k"), F.col("id").alias("at"))
    obs = rows.where("at % 7 = 0").withColumn("v", F.col("at"))
    out = asof.asof_join(rows, obs, ["k"], "at", "at", ["v"], strict=False, ranges=16)
    assert out.where("v <> at - at % 7 or v is null").count() == 0
    with pytest.raises(ValueError, match="named as values"):
        asof.asof_join(obs, obs, ["k"], "at", "at", ["v"])
    assert asof.asof_join(rows.limit(0), obs, ["k"], "at", "at", ["v"]).count() == 0 and asof.asof_join(rows.limit(3), obs.limit(0), ["k"], "at", "at", ["v"]).where("v is null").count() == 3


# ------------------------------------------------------------------ quantiles


def test_quantiles_by_selection(spark):
    """Small limits force many passes: spread values, ties that hold the ranks, two heavy values around them, nulls, NaN."""
    rng = np.random.default_rng(11)
    n = 3000
    columns = {
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-6, 6, n),
        "ties": rng.integers(0, 5, n).astype(float),
        "heavy": np.where(rng.random(n) < 0.49, -1.0, np.where(rng.random(n) < 0.97, 1.0, rng.random(n))),
        "one": np.full(n, 7.5),
    }
    rows = [tuple(float(v[i]) for v in columns.values()) for i in range(n)]
    rows = [(*r, None if i % 3 else float(i), None, float("nan") if i % 2 else -float(i)) for i, r in enumerate(rows)]
    names = [*columns, "holes", "empty", "nans"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    probs = [0.0, 0.1, 0.5, 0.731, 1.0]
    want = {**columns, "holes": np.array([float(i) for i in range(0, n, 3)]), "nans": np.array([-float(i) for i in range(0, n, 2)])}
    for most, accuracy in ((4096, 5000), (20, 50)):
        got = quantiles.quantiles(df, names, probs, most=most, accuracy=accuracy)
        assert got.pop("empty") == [None] * 5
        for c, v in got.items():
            assert v == pytest.approx(np.quantile(want[c], probs).tolist(), rel=1e-12), c


# ------------------------------------------------------------------ exponential means


def slow_mean(values, span, rule):
    a, y, gap, out = 2 / (span + 1), None, 0, []
    for v in values:
        if v is None:
            gap += 1
            y = None if rule == "reset" else y
            out.append(None if rule in ("hide", "reset") else y)
            continue
        w = (1 - a) ** (gap + 1) if rule == "decay" else 1 - a
        y = v if y is None else (w * y + a * v) / (w + a)
        gap = 0
        out.append(y)
    return out


@pytest.mark.parametrize("rule", scan.RULES)
def test_scan_against_a_fold(spark, rule):
    rng = random.Random(6)
    lines = {k: [None if rng.random() < holes else rng.gauss(50, 9) for _ in range(n)] for k, n, holes in (("long", 700, 0.1), ("holes", 200, 0.9), ("none", 30, 1.0), ("one", 1, 0.0))}
    rows = [(k, on(i), v, i) for k, line in lines.items() for i, v in enumerate(line)] + [(None, on(3), 1.0, 0), ("long", None, 1.0, -1)]
    df = spark.createDataFrame(rows, "k string, d date, x double, i int").repartition(4)
    got = scan.ema_scan(df, ["k"], "d", "x", 9, missing=rule, ranges=17).collect()
    assert len(got) == len(rows)
    want = {k: slow_mean(line, 9, rule) for k, line in lines.items()}
    for r in got:
        expected = None if r.k is None or r.d is None else want[r.k][r.i]
        assert r.ema == (None if expected is None else pytest.approx(expected, rel=1e-9))


def test_scan_of_a_long_line(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("K").alias("k"), F.col("id").alias("at"), F.sin(F.col("id") / 50).alias("x"))
    got = scan.ema_scan(df, ["k"], "at", "x", 21, ranges=32)
    last = got.where(F.col("at") == n - 1).first().ema
    y, a = 0.0, 2 / 22
    for i in range(n):
        y = a * math.sin(i / 50) + (1 - a) * y if i else math.sin(0)
    assert last == pytest.approx(y, rel=1e-9) and got.where("ema is null").count() == 0


# ------------------------------------------------------------------ vector index


def clustered(spark, n=600, d=12):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(15, d)) * 4
    x = centres[rng.integers(0, 15, n)] + rng.normal(size=(n, d))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(n, None), (n + 1, [float("nan")] + [0.0] * (d - 1)), (n + 2, [])]
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_vector_index_recall_and_pruning(spark, tmp_path):
    df = clustered(spark)
    queries = df.where("id % 20 = 0")
    index = vector_index.build_index(df, f"file://{tmp_path}/ix", "id", "v", cells=20)
    again = vector_index.open_index(spark.newSession(), index.path)
    assert np.allclose(again.centres, index.centres) and (again.key, again.vector) == ("id", "v")
    exact = embed.nearest(df.where("id < 600"), queries.where("id < 600"), "id", "v", 5)
    whole = vector_index.search(index, queries, 5, probes=99)
    pairs = lambda x: sorted((r["query"], r["rank"], r["id"]) for r in x.collect())
    assert pairs(whole) == pairs(exact)
    p = vector_index.probes_for(index, queries, 5, 0.95)
    assert p < 10
    few = vector_index.search(index, queries, 5, probes=p, block=7)  # several blocks
    assert vector_index.recall(few, exact, "id") >= 0.95
    one = vector_index.search(index, queries.where("id = 0"), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:80]
    files = {r.f for r in vector_index.search(index, queries.where("id = 0"), 99, probes=1).join(index.rows(spark).select("id", F.input_file_name().alias("f")), "id").collect()}
    assert len(files) == 1


def test_vector_index_of_nothing(spark, tmp_path):
    df = clustered(spark)
    index = vector_index.build_index(df.limit(0), f"file://{tmp_path}/ix", "id", "v")
    assert len(index.centres) == 1


# ------------------------------------------------------------------ label model


def test_label_model_on_many_functions(spark):
    """The distributed fit gives what the driver's gives, for 3 and for 70 functions (two pairs of masks)."""
    rng = np.random.default_rng(9)
    for m in (3, 70):
        y = rng.random(400) < 0.4
        v = np.where(rng.random((400, m)) < 0.3, np.where((rng.random((400, m)) < 0.8) == y[:, None], 1, -1), 0)
        names = [f"f{j}" for j in range(m)]
        df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(v)], "sample_id int, " + ", ".join(f"{c} int" for c in names))
        a, fit_a = weak.label_model(df, names, iterations=5)
        b, fit_b = weak.label_model(df, names, iterations=5, collected=0)
        assert fit_a["prior"] == pytest.approx(fit_b["prior"], rel=1e-9) and fit_a["accuracy"] == pytest.approx(fit_b["accuracy"], rel=1e-9) and fit_a["coverage"] == pytest.approx(fit_b["coverage"])
        p, q = ({r.sample_id: r.p_label for r in x.collect()} for x in (a, b))
        assert p == pytest.approx(q, abs=1e-9)
        assert np.mean([(p[i] > 0.5) == y[i] for i in range(400)]) > (0.95 if m > 3 else 0.6)


# ------------------------------------------------------------------ sampled pairs


def test_sampled_pairs_are_distinct_and_even(spark):
    tickers = spark.createDataFrame([(f"T{i}",) for i in range(40)] + [(None,), ("T1",)], "ticker string")
    days = spark.createDataFrame([(on(i), i) for i in range(50)], "date date, session_no int")
    every = {(f"T{i}", on(j)) for i in range(40) for j in range(50)}
    draw = lambda n, seed: [(r.ticker, r.date) for r in windows.sampled_pairs(tickers, days, n, seed).collect()]
    a = draw(400, 1)
    assert len(set(a)) == 400 and set(a) <= every and sorted(a) == sorted(draw(400, 1)) and set(a) != set(draw(400, 2))
    assert set(draw(100, 1)) < set(a)  # a larger sample holds the smaller one
    assert set(draw(9999, 3)) == every
    counts = np.zeros(40)
    for t, _ in itertools.chain(a, draw(400, 5), draw(400, 6)):
        counts[int(t[1:])] += 1
    assert ((counts - 30) ** 2 / 30).sum() < 80  # chi-square of 39 degrees: 80 is one in 7,000
    assert windows.sampled_pairs(tickers.limit(0), days, 5, 1).count() == 0


def test_fingerprint_knows_no_order(spark):
    df = spark.createDataFrame([(f"T{i % 7}", on(i)) for i in range(60)], "ticker string, date date")
    name = lambda x: tuple(windows.fingerprint(x, ["ticker", "date"]).first())
    assert name(df) == name(df.orderBy(F.desc("date")).repartition(5)) and name(df) != name(df.limit(59)) and name(df) != name(df.unionByName(df.limit(1)))
    assert name(df.limit(0))[0] == 0


def test_windows_refuse_repeated_samples(spark):
    one = [("s", "X", on(5), "flag", True)]
    kind = "sample_id string, ticker string, asof_date date, setup string, label boolean"
    days = spark.createDataFrame([(on(i), i) for i in range(9)], "date date, session_no int")
    bar = spark.createDataFrame([("X", on(i), 1.0, 1.0, 1.0, 1.0, 1) for i in range(9)], "ticker string, date date, open double, high double, low double, close double, volume bigint")
    assert windows.windowed(spark.createDataFrame(one, kind), days, bar, 3).count() == 3
    with pytest.raises(Exception, match="sample_id repeats: s"):
        windows.windowed(spark.createDataFrame(one * 2, kind), days, bar, 3).collect()


# ------------------------------------------------------------------ regimes


def walk(seed, n=200, names=("P", "Q")):
    rng = np.random.default_rng(seed)
    rows = []
    for t in names:
        close = 80.0
        for i in range(n):
            close *= math.exp(rng.normal(-0.01, 0.03) if (i // 30) % 2 else rng.normal(0.004, 0.006))
            rows.append((t, on(i), close))
    return rows


def test_regimes_know_nothing_behind_a_cut_off(spark):
    """Poisoning all bars from each cut-off on changes no probability before it."""
    rows = walk(1)
    cuts = [on(90).isoformat(), on(130).isoformat(), on(170).isoformat()]
    kind = "ticker string, date date, close double"
    whole = {(r.ticker, r.date): r.p_trend for r in models.regimes(spark.createDataFrame(rows, kind), cutoffs=cuts).collect()}
    assert len(whole) == 2 * 199
    for cut in (90, 130, 170):
        poisoned = [(t, d, c if d < on(cut) else c * (5.0 if d.day % 2 else 0.1)) for t, d, c in rows]
        got = {(r.ticker, r.date): r.p_trend for r in models.regimes(spark.createDataFrame(poisoned, kind), cutoffs=cuts).collect()}
        early = [k for k in whole if k[1] < on(cut)]
        assert all(got[k] == pytest.approx(whole[k], abs=1e-12) for k in early)
        assert any(abs(got[k] - whole[k]) > 0.01 for k in whole if k[1] >= on(cut))
    since = models.fit_regimes(models.returns_by_ticker(spark.createDataFrame(rows, kind)), [cuts[0], "1990-01-01"], since=on(20).isoformat())
    only = models.fit_regimes(models.returns_by_ticker(spark.createDataFrame([r for r in rows if r[1] >= on(19)], kind)), [cuts[0]])
    assert since[1] is None and np.allclose(since[0]["mean"], only[0]["mean"]) and np.allclose(since[0]["trans"], only[0]["trans"])


def test_the_57th_feature_is_of_the_bar_before(spark):
    bar = [(t, d, c, c * 1.01, c * 0.99, c, 1000) for t, d, c in walk(2)]
    df = spark.createDataFrame(bar, "ticker string, date date, open double, high double, low double, close double, volume bigint")
    days = spark.createDataFrame([(on(i), i) for i in range(200)], "date date, session_no int")
    samples = spark.createDataFrame([(f"s{i}", t, on(i), "flag", True) for t in ("P",) for i in (80, 120, 199)], "sample_id string, ticker string, asof_date date, setup string, label boolean")
    regime = models.regimes(df, cutoffs=[on(100).isoformat()])
    rows, names = jobs.feature_table(samples, days, df, regime=regime)
    assert len(names) == 57 and names[-1] == "p_regime"
    p = {r.date: r.p_trend for r in regime.where("ticker = 'P'").collect()}
    assert {r.sample_id: r.p_regime for r in rows.collect()} == {f"s{i}": p[on(i - 1)] for i in (80, 120, 199)}


# ------------------------------------------------------------------ stored pipelines


def labelled(spark, n=400):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.3 > 0).astype(float)
    split = np.where(np.arange(n) % 5 == 4, "test", np.where(np.arange(n) % 5 == 3, "val", "train"))
    rows = [(i, *(None if rng.random() < 0.1 else float(v) for v in x[i]), float(y[i]), str(split[i])) for i in range(n)]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, y double, split string")


@pytest.mark.parametrize("kind", stages.KINDS)
def test_a_stored_model_scores_unseen_rows_alike(spark, tmp_path, kind):
    rows = labelled(spark)
    model = stages.train(rows.where("split <> 'test'"), ["a", "b", "c"], kind=kind)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    unseen = rows.where("split = 'test'").drop("y", "split").withColumn("a", F.when(F.col("i") == 4, float("inf")).otherwise(F.col("a")))
    first = {r.i: (r.score, r.calibrated) for r in stages.scored(model, unseen, ["i"]).collect()}
    other = spark.newSession()
    loaded = PipelineModel.load(f"file://{tmp_path}/m")
    again = {r.i: (r.score, r.calibrated) for r in stages.scored(loaded, other.createDataFrame(unseen.collect(), unseen.schema), ["i"]).collect()}
    assert first == again and len(first) == 80
    truth = {r.i: r.y for r in rows.collect()}
    assert np.mean([(s > 0.5) == (truth[i] == 1) for i, (s, _) in first.items()]) > 0.75
    medians = model.stages[0].getOrDefault("medians") if kind != "leafwise" else []  # leaf-wise trees take missing values as they are
    for c, m in zip("abc", medians, strict=False):
        assert m == pytest.approx(np.median([r[c] for r in rows.where("split = 'train'").collect() if r[c] is not None]))


def greedy_tree(bins, g, h, leaves, ridge, least):
    """Best leaf first by trying every split of every leaf: the leaves' rows."""
    def split(rows):
        best = (1e-12, None)
        score = lambda k: g[k].sum() ** 2 / (h[k].sum() + ridge)
        for j in range(bins.shape[1]):
            for b in range(boosting.BINS):
                left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                if min(len(left), len(right)) >= least:
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        return best

    out = [(*split(np.arange(len(g))), np.arange(len(g)))]
    while len(out) < leaves:
        k = max(range(len(out)), key=lambda i: out[i][0])
        if out[k][1] is None:
            break
        _, (a, b), _ = out.pop(k)
        out += [(*split(a), a), (*split(b), b)]
    return sorted(sorted(rows.tolist()) for _, _, rows in out)


@pytest.mark.parametrize("at_once", [1, 3])
def test_leafwise_trees_against_brute_force(spark, at_once):
    rng = np.random.default_rng(31)
    n = 240
    x = rng.normal(size=(n, 3))
    x[rng.random((n, 3)) < 0.1] = np.nan
    x[:, 2] = np.round(x[:, 2])
    y = ((np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) > 0) ^ (rng.random(n) < 0.1)).astype(float)
    w = np.where(rng.random(n) < 0.3, 2.0, 1.0)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double, wt double").repartition(3)
    fit = boosting.LeafwiseBoosting(inputCols=["a", "b", "c"], weight="wt", trees=1, leaves=6, rate=1.0, least=10, at_once=at_once).fit(df)
    kept = boosting.json.loads(fit.getOrDefault("forest"))
    tree, bins = boosting.Tree(**kept["trees"][0]), boosting.binned(x, kept["cuts"])
    p = (y * w).sum() / w.sum()
    g, h = (p - y) * w, p * (1 - p) * w
    at = tree.nodes_of(bins)
    got = sorted(sorted(np.flatnonzero(at == k).tolist()) for k in np.unique(at))
    assert got == greedy_tree(bins, g, h, 6, 1.0, 10)
    for k in np.unique(at):
        assert tree.value[k] == pytest.approx(-g[at == k].sum() / (h[at == k].sum() + 1.0))
    want = 1 / (1 + np.exp(-(kept["base"] + np.array(tree.value)[at])))
    assert {r.i: r.score for r in fit.transform(df).collect()} == pytest.approx({i: float(v) for i, v in enumerate(want)})


def test_leafwise_boosting_stops_and_isnt_worse(spark):
    """On the labelled rows its held loss isn't above that of the level-wise trees; noise stops it early."""
    rows = labelled(spark)
    loss = lambda m: -np.mean([r.y * math.log(max(r.score, 1e-9)) + (1 - r.y) * math.log(max(1 - r.score, 1e-9)) for r in m.transform(rows.where("split = 'val'")).collect()])
    assert loss(stages.train(rows, ["a", "b", "c"], kind="leafwise")) <= loss(stages.train(rows, ["a", "b", "c"], kind="boosted")) + 0.01
    noise = rows.withColumn("y", F.pmod(F.xxhash64("i"), F.lit(2)).cast("double"))
    fit = boosting.LeafwiseBoosting(inputCols=["a", "b", "c"], held="split = 'val'", trees=40, patience=3).fit(noise)
    assert len(boosting.json.loads(fit.getOrDefault("forest"))["trees"]) < 20
    empty = boosting.LeafwiseBoosting(inputCols=["a"]).fit(rows.limit(0))
    assert empty.transform(rows).where("score <> 0.5").count() == 0


def test_scan_ranks_a_day(spark):
    names = [f"N{i}" for i in range(6)]
    bar = [(t, d, c, c * 1.01, c * 0.99, c, 1000) for t, d, c in walk(3, 160, names)]
    df = spark.createDataFrame(bar, "ticker string, date date, open double, high double, low double, close double, volume bigint")
    days = spark.createDataFrame([(on(i), i) for i in range(160)], "date date, session_no int")
    samples = spark.createDataFrame([(f"{t}-{i}", t, on(i), "flag", (i // 30) % 2 == 0) for t in names for i in range(65, 150, 4)], "sample_id string, ticker string, asof_date date, setup string, label boolean")
    table, features = jobs.training_table(samples, days, df)
    assert {r.split for r in table.select("split").distinct().collect()} == {"train", "val", "test"} and len(features) == 56
    assert table.groupBy("asof_date").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    model = stages.train(table, features)
    got = jobs.scan(df.select("ticker"), days, df, model).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6] and {r.ticker for r in got} == set(names) and {r.asof_date for r in got} == {on(159)}
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    poisoned = df.withColumns({c: F.when(F.col("date") >= F.lit(on(159)), 1e6).otherwise(F.col(c)) for c in ("high", "low", "close")})
    assert [(r.ticker, r.score) for r in jobs.scan(df.select("ticker"), days, poisoned, model).orderBy("rank").collect()] == [(r.ticker, r.score) for r in got]
    assert jobs.scan(df.select("ticker"), days, df, model, asof=on(400).isoformat()).count() == 0


# ------------------------------------------------------------------ stateful stream


def test_last_bars_by_a_stream_in_any_order(spark, tmp_path):
    """Three orders and splits of the same drops, with late bars and corrections, give the rows of the batch query."""
    from barwright.streaming.latest import BAR, last_bars_stream, read_last

    rng = random.Random(8)
    t0, t1 = dt.datetime(2031, 1, 1), dt.datetime(2031, 1, 2)
    rows = []
    for t, n in (("LONG", 60), ("MID", 12), ("ONE", 1)):
        for i in range(n):
            c = 20 + rng.random() * 5
            rows.append((t, on(i), c, c + 1, c - 1, c, rng.randrange(100, 900), t0))
            if i % 6 == 0:
                rows.append((t, on(i), c, c + 2, c - 1, c * 1.5, rng.randrange(100, 900), t1))
    kind = f"ticker string, {BAR}"
    newest = {}
    for r in rows:
        if (r[0], r[1]) not in newest or newest[r[0], r[1]][7] < r[7]:
            newest[r[0], r[1]] = r
    n = 15
    cols = ("ticker", "date", "close", "volume", "ret_1d", "ret_5d", "ret_21d", "vol_avg_20", "dollar_vol_avg_20", "range_pct", "rn")
    tidy = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    key = lambda rs: sorted(rs, key=str)
    want = key(tidy(B.last_n(B.features(spark.createDataFrame(list(newest.values()), kind)), n)))
    orders = [rows, sorted(rows, key=lambda r: r[1], reverse=True), rng.sample(rows, len(rows))]
    for k, (order, drops) in enumerate(zip(orders, (1, 3, 4), strict=True)):
        base = f"file://{tmp_path}/{k}"
        for d in range(drops):
            part = order[d * len(order) // drops : (d + 1) * len(order) // drops]
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
            last_bars_stream(spark, f"{base}/in", f"{base}/table", f"{base}/state", n=n).awaitTermination()
        assert key(tidy(read_last(spark, f"{base}/table", n))) == want


# ------------------------------------------------------------------ an index that is kept up to date


def test_two_drops_give_the_index_of_one(spark, tmp_path):
    from barwright.operators import window_index

    names = ["AA", "AB", "CC"]
    bar = [(t, d, c, c * 1.01, c * 0.99, c * 1.002, 500 + i) for i, (t, d, c) in enumerate(walk(12, 130, names))]
    df = spark.createDataFrame(bar, "ticker string, date date, open double, high double, low double, close double, volume bigint")
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    sizes, strides = (16, 32), (10, 25)
    update = lambda path, rows, **options: window_index.update_index(spark, path, rows, sizes, strides, **options)
    whole = update(one, df)
    early = update(two, df.where(F.col("date") < F.lit(on(70))))
    files = lambda: {str(f.relative_to(tmp_path)) for f in tmp_path.glob("two/windows/**/*.parquet")}
    before = files()
    late = update(two, df)
    assert early + late == whole and late and update(two, df) == 0
    columns = ["window_id", "ticker", "end_date", "window_size", "stride", "start_idx", "end_year_month", "ticker_bucket"]
    rows = lambda path: sorted((tuple(r[c] for c in columns), tuple(round(v, 6) for v in r.embedding)) for r in window_index.open_index(spark, path).collect())
    assert rows(one) == rows(two) and len(rows(two)) == whole
    months = {d.strftime("%Y-%m") for d in (on(i) for i in range(64))}
    untouched = {f for f in before if f.split("end_year_month=")[1][:7] in months and f.split("end_year_month=")[1][:7] != on(69).strftime("%Y-%m")}
    assert untouched and untouched <= files()  # the same files stand in folders without new windows
    m = {(r.ticker, r.window_size, r.stride): (r.last_date, r.n_windows) for r in window_index.manifest(spark, two).collect()}
    assert m == {(r.ticker, r.window_size, r.stride): (r.last_date, r.n_windows) for r in window_index.manifest(spark, one).collect()} and len(m) == 12
    with pytest.raises(ValueError, match="another encoder"):
        update(two, df, encoder=window_index.Encoder(dims=8))
    assert window_index.encoder_of(spark.newSession(), two) == window_index.Encoder()
    asked = window_index.open_index(spark, two).where("ticker = 'CC'").orderBy("end_date").limit(2).select("ticker", "end_date", "window_size", "stride", "start_idx")
    found = embed.lookup(window_index.open_index(spark, two), asked)
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
