"""Operators 11 to 13 against brute force: whitening, collocations, line dedup."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from edges import EDGES, lower
from pyspark.sql import functions as F

from barwright.llm import collocations as C
from barwright.llm import line_dedup as L
from barwright.llm import whitening as W

# ------------------------------------------------------------------ whitening


def vectors(spark, rows, kind="float"):
    """Rows (vec_id, embedding), with further columns whose names clash with the operator's."""
    return spark.createDataFrame([(i, v, "a", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, y string, v double")


def whitened(out):
    rows = out.collect()
    ids = sorted({r.vec_id for r in rows})
    k = max((r.component for r in rows), default=0)
    z = np.full((len(ids), k), np.nan)
    for r in rows:
        z[ids.index(r.vec_id), r.component - 1] = r.whitened
    return ids, z, rows


def integers(rows):
    return {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in rng.normal(size=6) @ mixed]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector in many rows counts once
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] + [0.0] * 5), (204, [float("-inf")] + [0.0] * 5), (205, [1.0, 2.0])]
    ids, z, out = whitened(W.whiten(vectors(spark, rows + odd, "double"), most=4))
    x = integers(rows)
    assert ids == sorted(x)
    fit = np.array(sorted(set(x.values())), float)
    n, total = len(fit), [sum(v) for v in zip(*sorted(set(x.values())), strict=True)]
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want = (np.array([x[i] for i in ids], float) - fit.mean(0)) @ axes / np.sqrt(values)
    for k in range(4):
        assert np.allclose(z[:, k], want[:, k], atol=1e-7) or np.allclose(z[:, k], -want[:, k], atol=1e-7)
    for r in out:
        assert r.n == n and r.identity_error < 1e-12
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(np.cov(fit.T, bias=True)), rel=1e-9)
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], total, strict=True))


def test_whitening_equal_eigenvalues_and_lost_dimensions(spark):
    """Unit vectors have one eigenvalue d - 1 times; a constant and a repeated dimension add none."""
    rows = [(i, [float(i == j) for j in range(5)] + [3.0, float(i == 0)]) for i in range(5)]
    ids, z, out = whitened(W.whiten(vectors(spark, rows), most=16))
    assert z.shape == (5, 4)
    assert np.allclose(z.T @ z / 5, np.eye(4), atol=1e-12) and out[0].identity_error < 1e-12
    shares = {r.component: r.explained for r in out}
    assert sum(shares.values()) == pytest.approx(1.0, rel=1e-12) and shares[1] >= shares[2] >= shares[3] >= shares[4]


def test_whitening_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = W.whiten(vectors(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_whitening_of_huge_entries_is_exact(spark):
    big = [(None, [1e30, 0.25]), (1, [2.0**40, 0.5]), (1, [0.0, 0.75]), (2, [-(2.0**35), 1.0])]
    out = W.whiten(vectors(spark, big, "double"), most=2).collect()
    y = [[min(max(math.floor(64 * c), -(2**61)), 2**61) for c in v] for _, v in big]
    n, total = 4, [sum(v) for v in zip(*y, strict=True)]
    want = Counter(sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in y)
    got = Counter(None if r.deviation is None else int(r.deviation) for r in out if r.component == 1)
    assert got == Counter({(k if k < 10**38 else None): v for k, v in want.items()})
    assert {r.vec_id for r in out} == {None, 1, 2} and len(out) == 8


def test_polynomial_and_roots(spark):
    c = [[2, 1, 0], [1, 2, 0], [0, 0, 5]]  # eigenvalues 5, 3, 1
    assert W.characteristic(spark, c) == [1, -9, 23, -15]
    poly = [1, -9, 23, -15]
    assert [W.roots_above(poly, m, 0) for m in (0, 1, 2, 3, 4, 5)] == [3, 2, 2, 1, 1, 0]
    assert [(m / 2**s, k) for m, s, k in W.top_roots(poly, 2)] == [(5.0, 1), (3.0, 1)]
    double = [1, -9, 24, -20]  # (x - 2)^2 (x - 5)
    assert [(round(m / 2**s, 9), k) for m, s, k in W.top_roots(double, 3)] == [(5.0, 1), (2.0, 2)]
    rng = np.random.default_rng(5)
    for a in (rng.integers(-9, 9, (5, 5)), np.diag([0, 0, 3, 0, 7]), np.fliplr(np.diag([1, 2, 0, 4, 5]))):  # pivots are missing in the last two
        m = a @ a.T
        minors = [sum(round(np.linalg.det(m[np.ix_(c, c)].astype(float))) for c in itertools.combinations(range(5), k)) for k in range(6)]
        for p in W.primes_beyond(1 << 40):
            assert W.polynomial_mod(m.astype(np.int64), p) == [(-1) ** k * x % p for k, x in enumerate(minors)]


# ------------------------------------------------------------------ collocations


def collocations_by_force(rows, support, inside, top):
    """rows: (lang, text)."""
    out = []
    by_lang = {}
    for lang, text in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(lower(text or ""))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
                w = re.findall(r"[^ \t]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
        every = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in every.items():
            longer = [b for q, b in every.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


WORDS = ["the", "The", "of", "new", "york", "city", "é", "ß", "a.b", "x"]


def prose(seed, n, least=0, most=40):
    rng = random.Random(seed)
    for _ in range(n):
        words = rng.choices(WORDS, [6, 2, 5, 3, 3, 2, 1, 1, 1, 1], k=rng.randint(least, most))
        yield "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "! "]) for w in words)


@pytest.mark.parametrize("shard_bytes", [1, 2_000, 1 << 24])
def test_collocations_against_brute_force(spark, docs_of, shard_bytes):
    """Shards of one text, of some texts, and one shard for each task find the same."""
    texts = [(i, t) for i, t in enumerate(prose(1, 300))] + [(1000 + i, t) for i, t in EDGES.items()] + [(5, "new york city " * 400)] * 3
    lang = {i: ("en", "fr", None, "und")[i % 4] for i, _ in texts}
    docs = docs_of(texts, lang=lang).withColumn("key", F.lit("x")).withColumn("lang", F.when(F.col("lang") == "en", "en").when(F.col("lang") == "fr", "fr").when(F.col("doc_id") % 4 == 3, "und"))
    rows = [(r.lang, r.text) for r in docs.collect()]
    for support, inside, top in ((8, 80, 2000), (3, 60, 7)):
        got = C.collocations(docs.repartition(3), support=support, inside=inside, top=top, shard_bytes=shard_bytes)
        got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
        assert got == collocations_by_force(rows, support, inside, top)


def test_collocations_of_nothing(spark, docs_of):
    for texts in ({}, {1: None}, {1: "one two", 2: ""}):
        out = C.collocations(docs_of(texts), support=2)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_the_lowered_support_hides_nothing(spark, docs_of):
    """A phrase spread thinly over all shards, below the lowered support in most of them, is counted whole."""
    texts = {i: "filler words here . " * 20 + ("rare pair . " if i % 2 else "") for i in range(40)}
    got = {r.phrase: r.a for r in C.collocations(docs_of(texts).repartition(4), support=20, shard_bytes=1000).collect()}
    assert got["rare pair"] == 20
    assert C.collocations(docs_of(texts), support=21).where("phrase = 'rare pair'").count() == 0


# ------------------------------------------------------------------ line dedup


def lines_by_force(texts, least, least_chars=1):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or n[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def spread(seed, n):
    rng = random.Random(seed)
    lines = [f"Line {i}" for i in range(12)] + [" line 1\t", "LINE 2", "\x0bline 3\r", "", " ", "é", "É", "line ", " "]
    return [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("broadcast_keys", [1 << 18, 0])
@pytest.mark.parametrize("batches", [1, 5])
def test_lines_against_brute_force(spark, docs_of, broadcast_keys, batches):
    texts = spread(2, 60) + [(100 + i, t) for i, t in EDGES.items()] + [(7, "only here\nline 4"), (7, "only here\nline 4"), (None, "line 5\nq")] + [(200 + i, "a common line\n" * 50) for i in range(30)]
    docs = docs_of(texts).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    for least, chars in ((10, 1), (3, 7)):
        got = L.dedup_lines(docs.repartition(7), least=least, least_chars=chars, batches=batches, broadcast_keys=broadcast_keys)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept"]
        rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str)
        assert rows == lines_by_force(texts, least, chars)


def test_lines_of_no_rows_and_clashing_results(spark, docs_of):
    assert L.dedup_lines(docs_of({})).count() == 0
    with pytest.raises(ValueError):
        L.dedup_lines(docs_of({1: "x"}).withColumn("kept", F.lit(1)))


def test_runs_are_levelled_and_know_what_is_common(spark):
    """Runs of seven batches stand at three levels; a key that is common already isn't added again."""
    runs = L.LineRuns(spark, 4, least=3)
    key = lambda *names: [bytearray(L.key_hash(x.encode())) for x in names]
    for i in range(7):
        rows = [(k, 3) for k in key("hot")] + [(k, 1) for k in key("warm", f"own {i}")]
        runs.add(spark.createDataFrame(rows, "key binary, n long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    total = Counter()
    for run in runs.runs():
        total.update({bytes(r.key): r.n for r in run.collect()})
    assert total[L.key_hash(b"hot")] == 3  # of the first batch alone
    assert total[L.key_hash(b"warm")] >= 3 and total[L.key_hash(b"own 6")] == 1
    plan = runs.runs()[0].join(runs.runs()[1].hint("merge"), "key", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {bytes(r.key) for r in runs.common().collect()} == {L.key_hash(b"hot"), L.key_hash(b"warm")} and [len(level) for level in runs.levels] == [0, 0, 1]
    names = list(runs.made)
    runs.close()
    assert names and not any(spark.catalog.tableExists(x) for x in names)


def test_query_digest_of_lines(spark, sf_dir):
    from barwright.llm import queries

    rows = queries.queries()["op13_line_dedup"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in lines_by_force(list(texts.items()), 10)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
