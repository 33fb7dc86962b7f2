"""Operators 2, 5, 6, 7 and 9 against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from edges import EDGES, lower
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barwright.llm import chat, decontaminate, fingerprints, substring_dedup, token_files
from barwright.llm.queries import tokenizer_file

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ 2


def test_token_files_round_trip(spark, docs_of, tmp_path):
    path = tokenizer_file("word_bpe_49k.json")
    texts = {**EDGES, 20: "It's a TEST... don't, X's. o.k., foo,. <|endoftext|> x <|ENDOFTEXT|>", 21: "word x　y é. ́abc 12,345. 你好，世界。", -5: "# # 2 end."}
    parts = token_files.write_token_files(docs_of(texts), path, f"file://{tmp_path}/f", end_id=2, length=16, batch_rows=2, by_word=True)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, parts).collect()}
    tokenizer, at, every = Tokenizer.from_file(path), 0, []
    for d in sorted(texts):
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        every += ids
    assert len(got) == len(texts)
    file = token_files.TokenFile(parts[0]["path"])
    ids, mask = file.sequence(1)
    assert len(ids) == 16 and mask.all() and ids.tolist() == every[16:32]
    tail = file.sequence(-(-parts[0]["n_tokens"] // 16) - 1)
    assert tail[1].sum() == (parts[0]["n_tokens"] - 1) % 16 + 1


def test_token_files_of_odd_rows(spark, docs_of, tmp_path):
    """Null and repeated ids, null and empty texts, and a text of two megabytes, against the tokenizer."""
    rng = random.Random(12)
    long = " ".join("".join(rng.choices("abcdefgh\u00e9", k=rng.randrange(1, 9))) for _ in range(400_000))
    rows = [(5, "b b"), (None, "null id"), (5, "a"), (3, None), (4, ""), (None, "an other"), (5, "b b"), (9, long), (10, "after it")]
    path = tokenizer_file("word_bpe_49k.json")
    parts = token_files.write_token_files(docs_of(rows).repartition(3), path, f"file://{tmp_path}/odd", end_id=2, by_word=True)
    got = token_files.read_token_files(spark, parts).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_whole_texts_and_of_nothing(spark, docs_of, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    parts = token_files.write_token_files(docs_of({1: "a b", 2: None}), path, f"file://{tmp_path}/g", end_id=50256)
    assert [r.n_tokens for r in token_files.read_token_files(spark, parts).orderBy("doc_id").collect()] == [3, 1]
    none = token_files.write_token_files(docs_of({}), path, f"file://{tmp_path}/h")
    assert token_files.read_token_files(spark, none).count() == 0


# ------------------------------------------------------------------ 5


def test_fingerprints(docs_of):
    rng = random.Random(0)
    texts = {**EDGES, **{20 + i: " ".join(rng.choice(["ab", "cd", "ef", "gh", "ijk"]) + rng.choice("xyz") for _ in range(200)) for i in range(6)}}
    texts[40] = texts[20]
    got = {r.doc_id: r for r in fingerprints.edit_report(docs_of(texts)).collect()}
    ids = sorted(texts)
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(t) // 2
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), sha(t[: len(t) - half] + nxt[:half]))
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[20].fingerprint == got[40].fingerprint and got[3].fingerprint == got[4].fingerprint and got[0].fingerprint == got[1].fingerprint == ""
    assert got[3].near_next == 1.0 and got[22].near_edited > got[22].near_next
    assert fingerprints.edit_report(docs_of({})).count() == 0
    assert fingerprints.edit_report(docs_of({7: "a b c d e f"})).first().near_next == 1.0


def test_syncmers_against_brute_force(spark, docs_of):
    words = [f"w{i * 7 % 11}" for i in range(40)]
    pairs = [(words[i], words[i + 1]) for i in range(39)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()
    r = [x.h for x in rows]
    keep = [(r[i], r[i + 2]) for i in range(37) if min(r[i], r[i + 2]) <= r[i + 1]]
    want = {x.h for x in spark.createDataFrame(keep, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()}
    got = fingerprints.with_anchors(docs_of({1: " ".join(words)}), "text", "m").first().m
    assert got == sorted(want)[:64]
    places = sorted((x.word, x.anchor) for x in fingerprints.anchors(docs_of({1: "  " + " ".join(words), 2: None, 3: "a b c"})).collect())
    assert [w for w, _ in places] == [i for i in range(37) if min(r[i], r[i + 2]) <= r[i + 1]] and {x for _, x in places} == want


def test_next_across_buckets(docs_of):
    df = fingerprints.with_next(docs_of({i * 3: f"t{i}" for i in range(50)}), "doc_id", ["text"], range_bytes=60)
    got = {r.doc_id: r.next_text for r in df.collect()}
    assert got == {i * 3: f"t{(i + 1) % 50}" for i in range(50)}


# ------------------------------------------------------------------ 6


def test_chat(spark):
    rows = [(1, 0, "system", "a\\b"), (1, 1, "user", None), (1, 2, "assistant", "<|end|> \\<|turn|> x"), (1, 3, "assistant", " \n"), (2, 0, None, "<"), (2, 1, "assistant", ""), (2, 2, "assistant", "é 😀\\"), (3, 0, "assistant", "<|endoftext|>"), (3, 0, "assistant", "<|endoftext|>"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    made = chat.format_conversations(df, tokenizer_file("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    assert chat.digest(chat.format_conversations(df.limit(0), tokenizer_file("byte_bpe_50k.json"))).count() == 0


def test_long_conversations_go_on_in_segments(spark, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " * 50) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.digest(chat.format_conversations(df, tokenizer_file("byte_bpe_50k.json"))).collect()
    big = spark.createDataFrame([(1, t, r, x * 300) for _, t, r, x in rows], df.schema)
    made = chat.format_conversations(big, tokenizer_file("byte_bpe_50k.json"))
    assert made.count() > 1 and chat.digest(made).count() == 1 and whole[0].n_turns == 40


@pytest.mark.parametrize("s", ["", "\\", "<|", "\\<|", "\\\\<|end|>", "<\\|", "a<", "|>"])
def test_escape_is_reversible(s):
    assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


# ------------------------------------------------------------------ 7


def brute_dedup(rows, window):
    first, words = {}, [(d, SPACED.findall(t or "")) for d, t in rows]
    for d, w in sorted(words, key=lambda x: x[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, y in zip(w, gone, strict=True) if not y))))
    return sorted(out)


def passages(seed, n=40, size=14):
    rng = random.Random(seed)
    pool = [[f"p{k}w{i}" for i in range(rng.choice((9, 10, 11, 25)))] for k in range(5)]
    rows = []
    for d in range(n):
        w = [f"d{d}x{rng.randrange(99)}" for _ in range(rng.choice((0, 5, size)))]
        for _ in range(rng.choice((0, 1, 2))):
            w += rng.choice(pool) + [f"d{d}y{rng.randrange(9)}"] * rng.choice((0, 1, 3))
        rows.append((100 + d, " ".join(w)))
    return rows + [(200, rows[3][1]), (200, rows[4][1]), (201, " ".join(["r"] * 40)), (202, " ".join(["r"] * 30)), (99, rows[5][1])]


@pytest.mark.parametrize("seed", [0, 1])
def test_dedup_against_brute_force(docs_of, seed):
    rows = list(EDGES.items()) + passages(seed)
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(docs_of(rows), window=10, period=7).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_dedup(rows, 10)


def test_dedup_windows_of_50(docs_of):
    a = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(a)), (2, " ".join(["z"] * 3 + a[20:70] + ["q"] * 4)), (3, " ".join(["y"] + a[20:69] + ["v"])), (4, "\n".join(a)), (5, None)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 50, 3: 0, 4: 120, 5: 0}
    assert substring_dedup.substring_dedup(docs_of({})).count() == 0


def test_dedup_of_several_texts_of_one_id(docs_of):
    rows = [(100 + i % 13, t) for i, (_, t) in enumerate(passages(2))]
    rows += [(7, " ".join(f"p{i}" for i in range(30))), (7, "q " * 12), (7, " ".join(f"p{i}" for i in range(5, 17)) + " s"), (7, "  ".join(f"p{i}" for i in range(30)))]
    rows += [(8, "t " + " ".join(f"p{i}" for i in range(3, 20))), (8, "t  " + " ".join(f"p{i}" for i in range(3, 20)))]
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(docs_of(rows), window=10, period=7).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_dedup(rows, 10)


def test_difference_cover():
    for v in (1, 2, 7, 10, 31):
        c = substring_dedup.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))
    assert len(substring_dedup.difference_cover(31)) == 6


# ------------------------------------------------------------------ 9


def brute_hits(texts, items, window=10):
    tok = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    win = {}
    for i, t in items:
        w = tok(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                win.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in texts.items():
        w, found = tok(t), set()
        hit = [0] * len(w)
        for m in {len(k) for k in win}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in win:
                    hit[i : i + m] = [1] * m
                    found |= win[k]
        out[d] = (len(w), sum(hit), len(found), decontaminate.hits_sha256(list(found)), sum(hit) > 0)
    return out


def benchmark_case(seed, short):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((10, 12, 30))))) for i in range(12)] + [(50, None), (51, ""), (52, "!?"), (12, items_text := "Only. Ten words; here a b c d e f"), (13, items_text)]
    if short:
        items += [(60, "v1 v2 v3"), (61, "zz"), (62, "v3 v3")]
    texts = dict(EDGES)
    for d in range(40):
        t = [rng.choice([*words, "other"]) for _ in range(30)]
        if d % 3 == 0:
            t[5:5] = (items[d % 12][1]).upper().split()
        texts[100 + d] = rng.choice((" ", ", ", "\n")).join(t)
    texts[200] = "x, ONLY ten words here a b c d e f"
    texts[201] = "zz"
    return texts, items


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_against_brute_force(spark, docs_of, short):
    texts, items = benchmark_case(3, short)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BENCHMARK_BYTES, 200):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs_of(texts), bench, benchmark_bytes=most).collect()}
        assert got == brute_hits(texts, items)


def test_decontamination_cuts_only_hits(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = {**EDGES, 20: f"before, {item}! after and more words so that the share of hits stays at half or below it all", 21: item, 22: "clean  text\tstays"}
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs_of(texts), bench).collect()}
    assert 21 not in got and got[22] == texts[22] and all(got[d] == texts[d] for d in EDGES)
    assert got[20] == texts[20].replace(item, "")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs_of(texts), none).where("contaminated").count() == 0


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_in_parts_is_that_of_one(spark, docs_of, short):
    texts, items = benchmark_case(3, short)
    a, b = (" ".join(f"{c}{i}" for i in range(10)) for c in "ab")
    meet = " ".join(f"{c}{i}" for c in "ab" for i in range(5, 15))[: -len("b10 b11 b12 b13 b14") - 1]
    items += [(70, a), (71, b), (72, " ".join([*a.split()[5:], "b0", "b1", "b2", "b3", "b4"])), (73, meet)]
    rest = lambda n: " ".join(f"r{i}" for i in range(n))
    rows = [*texts.items(), (300, f"{a} {rest(12)} {b}"), (301, f"x {a} {b} {rest(40)}"), (302, f"{rest(30)} {a}, {b}; {rest(9)}"), (303, f"{a} {rest(30)}"), (303, f"{rest(30)} {b}"), (None, f"{rest(25)} {b}"), (None, rest(7))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows)
    key = lambda r: str(tuple(r))
    one, many = (sorted(map(key, decontaminate.decontaminated(docs, bench, benchmark_bytes=most).collect())) for most in (1 << 20, 60))
    assert one == many and 300 not in {r.doc_id for r in decontaminate.decontaminated(docs, bench, benchmark_bytes=60).collect()}
    one, many = (sorted(map(key, decontaminate.matches(docs, bench, benchmark_bytes=most).collect())) for most in (1 << 20, 60))
    assert one == many


# ------------------------------------------------------------------ 5, by place


def test_positional_matches_against_brute_force(spark, docs_of, monkeypatch):
    """Shared passages at other places come out with their shift; a common passage is dealt out by salts."""
    from barwright.llm import fingerprints

    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, common = [word() for _ in range(40)], [word() for _ in range(25)]
    texts = {i: " ".join([*(word() for _ in range(rng.randrange(30))), *common, *(word() for _ in range(9))]) for i in range(40)}
    texts[50] = " ".join([*(word() for _ in range(13)), *passage, *(word() for _ in range(5))])
    texts[51] = " ".join([*(word() for _ in range(70)), *passage])
    texts[52] = " ".join(passage[:3])
    texts[53], texts[54] = None, ""
    docs = docs_of(list(texts.items()) + [(None, texts[50]), (51, texts[51])])
    queries = docs.where("doc_id in (50, 0, 53)")
    own = {}
    for r in fingerprints.anchors(docs).where("doc_id is not null").collect():
        own.setdefault(r.doc_id, set()).add((r.word, r.anchor))
    want = {}
    for q in (50, 0):
        for d, anchors in own.items():
            for x, h in own[q]:
                for y, g in anchors:
                    if d != q and g == h:
                        want.setdefault((q, d, y - x), []).append(x)
    want = {k: (len(v), min(v), max(v) + 3) for k, v in want.items() if len(v) >= 2}
    for hot in (10_000, 5):
        monkeypatch.setattr(fingerprints, "HOT_ROWS", hot)
        got = {(r["query"], r.doc_id, r["shift"]): (r.n_anchors, r.first_word, r.last_word) for r in fingerprints.positional_matches(queries, docs).collect()}
        assert got == want
    n, first, last = got[50, 51, 57]
    assert n >= 10 and 13 <= first < 20 and 45 < last <= 52


def test_edit_report_of_odd_rows(docs_of):
    """Null ids come first, repeated ones follow one another by text, and the last row's next is the first."""
    rows = [(2, "delta echo foxtrot golf"), (None, "alpha bravo"), (1, "hotel india"), (1, None), (3, "x" * 50_001), (2, "charlie")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        own, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        want.append((i, len(own), hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edit_report(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
