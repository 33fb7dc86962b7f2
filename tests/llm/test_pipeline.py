"""The pipeline's stages against brute force, each on its own input; and columns, ids and texts that could get in the way."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_learned_and_dealt import brute_targets
from test_ngram_join import brute
from test_text_operators import SPACED, brute_dedup, sha

import corpus_pipeline
from barwright.llm import decontaminate, fingerprints, language, mixing, ngram_join, quality, sharding, substring_dedup
from barwright.llm.common import written

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_quality(docs, labels):
    """Ids whose text, scored alone by the model of the labels outside the held-out fold, has 0.3 or more."""
    own = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = quality.fit_quality(docs.select("doc_id", "text"), labels.where(own))
    return [r for r in docs.collect() if float(model.scores([(r.text or "").encode()])[0]) >= 0.3]


def brute_clean(rows, items, window=10, most_words=1000):
    """Rows without the words that windows of items cover, each run cut from its first to its last letter."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    windows = set()
    for t in items:
        w = TOKEN.findall(low(t))
        windows |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1)) if w}
    out = []
    for r in rows:
        found = list(TOKEN.finditer(low(r.text)))
        w, hit = [m.group() for m in found], [False] * len(found)
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit[i : i + m] = [True] * m
        runs, i = [], 0
        while i < len(w):
            if hit[i]:
                j = i
                while j < len(w) and hit[j]:
                    j += 1
                runs.append((i, j))
                i = j
            else:
                i += 1
        if sum(hit) > 0.5 * len(w) or any(b - a > most_words for a, b in runs):
            continue
        text, last = "", 0
        for a, b in runs:
            text, last = text + r.text[last : found[a].start()], found[b - 1].end()
        out.append((r.doc_id, r.text if not runs else text + r.text[last:]))
    return out


def brute_copies(rows):
    size = [len(SPACED.findall(r.text or "")) for r in rows]
    sums = {}
    for r, n in zip(rows, size, strict=True):
        sums[r.source] = sums.get(r.source, 0) + n
    target = brute_targets(sums)
    rate = {s: target[s] / sums[s] if sums[s] else 0.0 for s in sums}
    number = lambda r: int(hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
    every = [[int(rate[r.source]) + ((number(r) - k / 64) % 1 < rate[r.source] % 1) for k in range(64)] for r in rows]
    best = {}
    for s in sums:
        own = [(c, n) for r, c, n in zip(rows, every, size, strict=True) if r.source == s]
        best[s] = min(range(64), key=lambda k: (abs(sum(c[k] * n for c, n in own) - target[s]), k))
    return [min(c[best[r.source]], 2) for r, c in zip(rows, every, strict=True)]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, sf_dir))
        after = docs.collect()
        if name == "quality":
            assert sorted(map(str, after)) == sorted(map(str, brute_quality(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{sf_dir}/labels.parquet"))))
        elif name == "near_duplicates":
            comp = brute({r.doc_id: r.text for r in before})
            assert sorted(map(str, after)) == sorted(str(r) for r in before if comp[r.doc_id][1] == r.doc_id)
        elif name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert sorted((r.doc_id, r.text) for r in after) == sorted(brute_clean(before, items)) and all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "mix":
            assert sorted(map(str, after)) == sorted(str(r) for r, n in zip(before, brute_copies(before), strict=True) for _ in range(n))
        if name != "shard":
            assert docs.columns == columns
        else:
            assert sorted((r.doc_id, r.text_crc32) for r in after) == sorted((r.doc_id, zlib.crc32((r.text or "").encode())) for r in before)
            slots, sizes = {}, {}
            for r in after:
                slots.setdefault(r.shard, []).append(r.slot)
                sizes[r.shard] = sizes.get(r.shard, 0) + r.size
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
            assert max(sizes.values()) - sum(sizes.values()) / 24 <= 2 * max(r.size for r in after)


NAMES = ("size", "source_size", "target", "copies", "_copy", "_size", "_source", "_score", "score", "_gone", "_row", "_n_words", "_spans", "_bytes", "_own", "_k", "_to", "token", "s1", "h", "c", "n", "node", "part", "th", "range")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents without an id, with a repeated one, without a text or a source, of 3 MB, and with columns of clashing names."""
    w = [f"w{i}" for i in range(90)]
    big = " ".join(f"b{i % 5003}x{i % 97}" for i in range(300_000))
    rows = [(1, " ".join(w), "en", "a"), (1, " ".join(w[:70]), "de", "a"), (1, " ".join(w), "en", "a"), (None, " ".join(w[5:]), "en", None), (None, None, None, None), (None, "clean and short", "en", "b"), (2, None, "en", "b"), (2, "", None, "b"), (3, " \t", "en", ""), (4, " ".join(w) + " z", "en", "a"), (5, big, "en", "b"), (6, big + " q", "en", "b")]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in NAMES)).repartition(3)


def test_stages_keep_odd_columns(spark, sf_dir, odd):
    count = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        rows = out.collect()
        count[name] = len(rows)
        assert out.columns == odd.columns and all(r[c] == f"own {c}" for r in rows for c in NAMES)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert count["near_duplicates"] == len({"w", "w70", "null", "clean", "2null", "2empty", "blank", "big"}) and count["decontaminate"] == 12
    shards = corpus_pipeline.deal_shards(spark, odd, sf_dir).collect()
    assert len(shards) == 12 and len({(r.shard, r.slot) for r in shards}) == 12


def test_operators_take_odd_rows(spark, sf_dir, odd):
    rows = odd.collect()
    joined = ngram_join.ngram_join(odd).collect()
    assert len(joined) == 12 and {r.component_id for r in joined if r.n_shingles == 86} == {1} and {r.component_id for r in joined if r.n_shingles > 10_000} == {5}
    none = [r for r in joined if r.doc_id is None]
    assert {(r.n_shingles, r.component_id) for r in none if r.n_shingles == 0} == {(0, None)}
    got = substring_dedup.substring_dedup(odd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    with_id = sorted(tuple(r) for r in got if r.doc_id is not None)
    assert with_id == brute_dedup([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 50)
    assert sorted((r.n_removed, r.kept_sha256) for r in got if r.doc_id is None) == sorted((0, sha(" ".join(SPACED.findall(r.text or "")))) for r in rows if r.doc_id is None)
    bench = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (None, "clean and short"), (1, "w40 w41")], "item_id long, text string").withColumn("own", F.lit(1))
    one, parts = (sorted(map(str, decontaminate.report(odd, bench, benchmark_bytes=most).collect())) for most in (1 << 20, 10))
    assert one == parts and sum("contaminated=True" in x for x in one) == 5
    assert fingerprints.edit_report(odd).count() == 12 and mixing.report(odd).count() == 12 and sharding.shard(odd).count() == 12
    model = quality.fit_quality(odd, spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, quality int"))
    assert len({r.score for r in quality.score_quality(odd, model).where("text is null or text = ''").collect()}) == 1
    found = language.identify_language(odd, language.fit_language(odd)).collect()
    assert len(found) == 12 and sum(r.lang_pred == "und" for r in found) == 4


def test_an_automaton_in_flat_arrays(spark):
    """Longest matches, items and short items of the automaton against substrings by hand."""
    items = [(7, "a b a b c"), (8, "b c d"), (9, "c"), (10, "")]
    automaton, vocabulary = decontaminate.build(items, window=4)
    places = {w: int(k) for w, k in zip("abcd", _ids("a b c d", vocabulary), strict=True)}
    scan = automaton.scanner()
    run = lambda s: (lambda x: (x[0], automaton.items_of(x[1])))(scan([places[w] for w in s]))
    assert run("babc") == ([(0, 4)], [7, 9]) and run("abab") == ([(0, 4)], [7]) and run("abcd") == ([(1, 4)], [8, 9]) and run("dab") == ([], [])
    assert automaton.least == 1


def _ids(text, vocabulary):
    import numpy as np
    import pyarrow as pa

    from barwright.llm.common import ALNUM, LOWER, buffer_of, word_hashes, word_spans

    data, off = buffer_of(pa.array([text]))
    starts, ends, _ = word_spans(data, off, ALNUM)
    return np.searchsorted(vocabulary, word_hashes(data, starts, ends, LOWER))


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 120} " * (1 + i % 7)) for i in range(840)] + [(5000 + i, "long " * 400) for i in range(3)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    of, size = {}, {}
    for r in found:
        of.setdefault(r.text_crc32, set()).add(r.shard)
        size[r.text_crc32] = size.get(r.text_crc32, 0) + r.size
    longest = max(r.size for r in found)
    assert all(len(s) == 1 for k, s in of.items() if size[k] <= longest)
