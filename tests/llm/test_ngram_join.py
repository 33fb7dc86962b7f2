from __future__ import annotations

import random
import re

import numpy as np
from edges import EDGES, lower

from barwright.llm import ngram_join as N
from barwright.llm.graph import connected_components


def sets_of(texts):
    out = {}
    for d, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(x))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts):
    s, up = sets_of(texts), {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(s[a] & s[b])
            if k and 100 * k >= 80 * (len(s[a]) + len(s[b]) - k):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s[d]), root(d)) for d in ids}


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(rng.choice((8, 40, 120)))] for _ in range(12)]
    line = [word() for _ in range(15)]
    out = dict(EDGES)
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            w[rng.randrange(len(w))] = word()
        out[100 + i] = " ".join(w + (line if i % 3 == 0 else []))
    return out


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force(docs_of):
    t = texts()
    assert result(N.ngram_join(docs_of(t))) == brute(t)


def test_blocks_in_parts_lose_no_link(docs_of):
    t = texts(2, 40)
    assert result(N.ngram_join(docs_of(t), block_docs=2)) == brute(t)


def test_frequent_hashes_last(docs_of, monkeypatch):
    t = texts(3, 30)
    monkeypatch.setattr(N, "HOT_SHARE", 0.0)  # in the driver alone: the list itself is cut to one hash
    monkeypatch.setattr(N, "HOT_LIST", 1)
    assert result(N.ngram_join(docs_of(t))) == brute(t)


def test_first_hashes_keep_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * 0.95)], rng.integers(0, 200, 2).astype(np.uint64)]))
        k = len(np.intersect1d(a, b))
        hot = np.arange(0, 200, 3).astype(np.uint64)
        if 100 * k >= 80 * (len(a) + len(b) - k):
            assert set(N.first_hashes(a, hot)) & set(N.first_hashes(b, hot))


def test_tree_drops_no_link():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (20, 100, 500)]
    sets = [np.unique(np.concatenate([u[rng.random(len(u)) > 0.05], rng.integers(0, 2**63, 2).astype(np.uint64)])) for u in base for _ in range(30)]
    found = {tuple(sorted(p)) for p in N.possible_pairs([len(u) for u in sets], [N.bitmap(u) for u in sets])}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                assert (i, j) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 4


def test_repeated_ids_nulls_and_nothing(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = N.ngram_join(docs_of(rows)).collect()
    assert len(got) == 5 and all(r.component_id == 1 for r in got)
    assert N.ngram_join(docs_of({})).count() == 0


def test_one_of_each(docs_of):
    t = texts(4, 30)
    kept = N.one_of_each(docs_of(t))
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute(t).items() if c == d}
    assert kept.columns == docs_of(t).columns


def test_one_of_each_without_ids_and_of_repeated_ids(docs_of):
    w = [f"w{i}" for i in range(60)]
    whole, near, other = " ".join(w), " ".join([*w[:-1], "x"]), " ".join(f"o{i}" for i in range(20))
    clean = " ".join(f"n{i}" for i in range(9))
    rows = [(3, whole), (3, whole), (3, other), (5, near), (5, "a clean text of an id that repeats"), (None, clean), (None, near), (None, None), (9, None), (9, None), (9, ""), (2, near + " y")]
    got = sorted(((r.doc_id, r.text) for r in N.one_of_each(docs_of(rows)).collect()), key=str)
    assert got == sorted([(2, near + " y"), (3, other), (5, "a clean text of an id that repeats"), (None, clean), (None, None), (9, None), (9, "")], key=str)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_texts_stay_where_they_are(docs_of):
    """The rows that stay are told by bits that go to the texts: no exchange in the plan carries texts."""
    plan = N.one_of_each(docs_of(texts(5, 30)))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(_row" not in plan


def test_each_row_has_its_own_bit(docs_of):
    """More rows in a partition than a word has bits; of three copies each the first stays."""
    t = {i: f"a{i // 3} b{i // 3} c{i // 3} d{i // 3} e{i // 3}" for i in range(600)}
    assert {r.doc_id for r in N.one_of_each(docs_of(t).coalesce(1)).collect()} == set(range(0, 600, 3))


def test_many_rows_to_send_are_shuffled(docs_of, monkeypatch):
    from barwright.llm import common

    t = texts(6, 40)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {r.doc_id for r in N.one_of_each(docs_of(t)).collect()} == {d for d, (_, c) in brute(t).items() if c == d}


def test_whole_sets_go_to_one_group(spark):
    """Near copies that meet in three blocks are checked as one group; a group larger than a block stays as it was."""
    rows = [(1, "0", 1, 1), (1, "0", 1, 2), (1, "0", 1, 3), (2, "0", 2, 2), (2, "0", 2, 3), (3, "1", 3, 3), (3, "1", 3, 4), (9, "0", 9, 9), (9, "0", 9, 10)]
    left = spark.createDataFrame([(*r, 50, None) for r in rows], "leader long, part string, sub long, s1 long, n long, comp long")
    groups = lambda *most: sorted(tuple(r) for r in N.regrouped(left, *most).select("leader", "part", "sub", "s1").collect())
    assert groups(4, 1000) == [(1, "", 1, x) for x in (1, 2, 3, 4)] + [(9, "", 9, 9), (9, "", 9, 10)]
    assert groups(3, 1000) == groups(4, 199) == sorted([*rows[:7], (9, "", 9, 9), (9, "", 9, 10)])


def test_sets_of_no_like_size_get_no_bitmaps(spark):
    rows = [(1, "0", 100), (1, "0", 80), (1, "0", 63), (1, "0", 51), (1, "0", 20), (2, "0", 20), (2, "0", 24), (3, "0", 7), (4, "0", 9), (4, "0", 9)]
    got = N.of_like_size(spark.createDataFrame(rows, "leader long, part string, n long"), 80)
    sizes = lambda k: [n for x, _, n in rows if x == k]
    want = [r for r in rows if sum(100 * min(n, r[2]) >= 80 * max(n, r[2]) for n in sizes(r[0])) > 1]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_bitmaps_are_short_and_tell_unrelated_sets_apart():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 64, 65, 512, 512, 600, 4096, 4000)]
    assert [len(N.bitmap(u)) * 8 for u in sets] == [64, 64, 128, 512, 512, 1024, 4096, 4096]
    assert not list(N.possible_pairs([len(u) for u in sets], [N.bitmap(u) for u in sets]))
