"""Phrase collocation mining (operator 12) by SON partitioning: frequent phrases of 2 to 4 words, for each language.

A shard is some MB of text within a task. Each is mined completely at a support lowered to its share of the language's
words: a phrase that occurs often enough in all has its share of occurrences in some shard. What shards find is united,
and a phrase stays if its counts, plus what shards may have left out, can reach the support. Longer phrases are mined only
where all their parts may be frequent; which ones may is a bitmap of fixed size, so that nothing broadcast grows with the
data. In the end the candidates are counted in all texts, exactly.

Phrases go by a 64-bit hash of their language and words; two that collide count as one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, contains, long_array, mix, small_batches, word_hashes, word_spans, written

SUPPORT, INSIDE, TOP = 30, 80, 2000
LONGEST = 4
SHARD_BYTES = 8 << 20  # of text in a shard, about
BLOCK = 1 << 20  # of text whose words are found at once
LEAST_BITS, MOST_BITS = 20, 27  # of a filter: 128 KB to 16 MB
OUT_ROWS = 1 << 16  # in a batch that a shard gives out
LANGUAGES = 10_000  # whose sizes lower the support; others are mined at a support of 1

_BYTES = np.arange(256)
IS_BREAK = np.isin(_BYTES, list(b".,;:!?\n\x0b\x0c\r"))
IS_WORD = ~(IS_BREAK | np.isin(_BYTES, list(b" \t")))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class Filter:
    """A set of keys as bits, two for each: never says no to a member. Keys are the upper 64 - shift bits of hashes."""

    def __init__(self, words: np.ndarray, shift: int = 0):
        self.words, self.shift = words, np.uint64(shift)

    def has(self, h: np.ndarray) -> np.ndarray:
        first, second = _places(h >> self.shift, len(self.words))
        return self._bit(first) & self._bit(second)

    def _bit(self, bit: np.ndarray) -> np.ndarray:
        return ((self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _places(keys: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    m, mask = mix(keys), np.uint64(64 * n_words - 1)
    return m & mask, (m >> np.uint64(32)) & mask


def filter_of(keys: DataFrame) -> np.ndarray:
    """The bits of keys(key: long), a written table: about 16 for a key, 16 MB at most, whatever the number of keys."""
    n = 1 << (min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length())) - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(n, np.uint64)
        for batch in batches:
            for bit in _places(batch.column(0).to_numpy().view(np.uint64), n):
                np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        used = np.flatnonzero(words)
        yield from _sliced(pa.RecordBatch.from_arrays([pa.array(used), long_array(words[used])], ["word", "bits"]))

    rows = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def _sliced(rows: pa.RecordBatch, most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    for k in range(0, rows.num_rows, most):
        yield rows.slice(k, most)


# ------------------------------------------------------------------ words of a block


class Words:
    """Words of a block of texts: spans, hashes of word, language and phrases, and where words follow one another."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lang: np.ndarray, salts: np.ndarray, longest: int):
        self.data = data
        self.starts, self.ends, self.first = word_spans(data, off, IS_WORD)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.lang = lang[doc]
        one = mix(word_hashes(data, self.starts, self.ends, LOWER) ^ salts[self.lang]) if len(doc) else np.zeros(0, np.uint64)
        breaks = np.cumsum(IS_BREAK[data])[self.starts] if len(doc) else np.zeros(0, np.int64)
        follows = (breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1])
        self.hashes, self.whole = {1: one}, {1: np.ones(len(one), bool)}
        for k in range(2, longest + 1):
            h, ok = self.hashes[k - 1], self.whole[k - 1]
            n = max(0, len(one) - k + 1)
            self.hashes[k] = mix(h[:n] * _STEP ^ one[k - 1 : k - 1 + n])
            self.whole[k] = ok[:n] & follows[k - 2 : k - 2 + n]

    def parts(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases of k words at the given places: hashes of what is before each cut, of what is behind it, and of the
        shorter phrases of two words or more inside; a row for each phrase."""
        part = lambda a, b: self.hashes[b - a][at + a]
        inner = [part(a, b) for a in range(k) for b in range(a + 2, k + 1) if b - a < k]
        stacked = lambda columns: np.stack(columns, 1) if columns else np.zeros((len(at), 0), np.uint64)
        return stacked([part(0, j) for j in range(1, k)]), stacked([part(j, k) for j in range(1, k)]), stacked(inner)

    @functools.cached_property
    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, A-Z lower-cased, joined by a space, and where each begins in it."""
        size = self.ends - self.starts
        begin = np.cumsum(size + 1) - (size + 1)
        source = np.repeat(self.starts - begin, size + 1) + np.arange(int((size + 1).sum()))
        joined = LOWER[self.data[np.minimum(source, len(self.data) - 1)]]
        joined[begin + size] = 0x20
        return joined, begin

    def texts(self, k: int, at: np.ndarray) -> pa.Array:
        """The phrases of k words at the given places, their words joined by a space."""
        joined, begin = self._joined
        last = at + k - 1
        length = begin[last] + self.ends[last] - self.starts[last] - begin[at]
        off = np.concatenate([[0], np.cumsum(length)])
        out = joined[np.repeat(begin[at] - off[:-1], length) + np.arange(off[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out.tobytes())).cast(pa.string())


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Shards:
    """Blocks of words of a task with their language codes and phrases of up to `longest` words, in shards of about `most`
    bytes."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.langs, self.salts = most, longest, {}, np.zeros(0, np.uint64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, bool]]:
        """Words of each block, and whether its shard ends with it."""
        held, last = 0, None
        for rows, data, off in blocks(batches, most=BLOCK):
            names = rows.column(rows.schema.get_field_index("lang")).to_pylist()
            for x in names:
                if x not in self.langs:
                    self.langs[x] = len(self.langs)
                    self.salts = np.append(self.salts, np.uint64(_salt(x)))
            if last is not None:
                yield last, held >= self.most
                held = 0 if held >= self.most else held
            last = Words(data, off, np.array([self.langs[x] for x in names], np.int32), self.salts, self.longest)
            held += len(data)
        if last is not None:
            yield last, True

    def names(self) -> list[str]:
        return list(self.langs)


def _counted(hashes: list[np.ndarray], langs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their counts and language codes."""
    h, lang = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*langs, np.zeros(0, np.int32)])
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h))), lang[order[first]]


# ------------------------------------------------------------------ mining


def _found(docs: DataFrame, pick: Callable[[Words], list[tuple[int, np.ndarray]]], longest: int, sizes: dict[str, int], support: int, shard_bytes: int, give, schema: str) -> DataFrame:
    """What give(names, keys, gains, codes, languages, totals) makes of each shard: sorted keys of phrases whose count in it
    is at least the lowered support, their counts less what is hidden of any phrase (that support less 1), and their
    languages' codes; and for each language of the shard the hidden count, or without sizes the words. pick gives (k,
    places) of the phrases that are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, hashes, langs, words = _Shards(shard_bytes, longest), [], [], []
        for block, ends in shards(batches):
            words.append(np.bincount(block.lang, minlength=len(shards.langs)))
            for k, at in pick(block):
                hashes.append(block.hashes[k][at])
                langs.append(block.lang[at])
            if not ends:
                continue
            names = shards.names()
            n = sum((np.pad(x, (0, len(names) - len(x))) for x in words), np.zeros(len(names), np.int64))
            hidden = np.array([-(-support * int(w) // sizes[x]) - 1 if w and x in sizes else 0 for w, x in zip(n, names, strict=True)], np.int64)
            keys, counts, of = _counted(hashes, langs)
            hashes, langs, words = [], [], []
            gain = counts - hidden[of]
            keep, seen = gain > 0, np.flatnonzero(n)
            yield from give(names, keys[keep], gain[keep], of[keep], seen, (hidden if sizes else n)[seen])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _words_of(docs: DataFrame, support: int, shard_bytes: int) -> DataFrame:
    """(lang, key, gain): words of at least `support` occurrences, and for each language a row of key null with all its words.
    Written."""

    def give(names, keys, gain, of, seen, totals) -> Iterator[pa.RecordBatch]:
        lang = pa.array(names, pa.string()).take(pa.array(np.concatenate([of, seen])))
        key = pa.concat_arrays([long_array(keys), pa.nulls(len(seen), pa.int64())])
        yield from _sliced(pa.RecordBatch.from_arrays([lang, key, pa.array(np.concatenate([gain, totals]).astype(np.int64))], ["lang", "key", "gain"]))

    rows = _found(docs, lambda b: [(1, np.arange(len(b.lang)))], 1, {}, support, shard_bytes, give, "lang string, key long, gain long")
    rows = rows.groupBy("lang", "key").agg(F.sum("gain").alias("gain"))
    return written(rows.where((F.col("gain") >= support) | F.col("key").isNull()))


PACK_ROWS = 1 << 22  # phrases of all shards in a range of keys, about
MOST_RANGES = 1 << 16
GAIN_BYTES = 4


def _packed(keys: np.ndarray, gain: np.ndarray, width: int) -> bytes:
    """Sorted keys as differences of `width` bytes and their gains, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    gains = np.minimum(gain, (1 << 32) - 1).astype("<u4").view(np.uint8).reshape(-1, GAIN_BYTES)
    return pa.compress(np.concatenate([steps.T.ravel(), gains.T.ravel()]).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, n * (width + GAIN_BYTES), codec="zstd", asbytes=True), np.uint8)
    steps, gains = np.zeros((n, 8), np.uint8), raw[n * width :].reshape(GAIN_BYTES, n).T
    steps[:, :width] = raw[: n * width].reshape(width, n).T
    return np.cumsum(steps.view("<u8").ravel()), np.ascontiguousarray(gains).view("<u4").ravel().astype(np.int64)


def _may_reach(docs: DataFrame, pick: Callable[[Words], list[tuple[int, np.ndarray]]], longest: int, sizes: dict[str, int], support: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """Keys (key) of phrases whose counts can reach the support, counting what shards found and all that they may hide, and
    the bits that keys are shorter than hashes. Written.

    Keys have some 8 bits more than the number of words has; two phrases of one key count together here, which makes
    candidates more, never fewer. A shard gives its sorted keys out in ranges, packed to 3 bytes a phrase or so; each range
    of a language is added up in one group of some PACK_ROWS phrases (beyond 2^38 words ranges are no longer split).
    """
    total = max(1, sum(sizes.values()))
    bits = min(63, max(32, total.bit_length() + 8))
    ranges = min(MOST_RANGES, 1 << max(3, (total // PACK_ROWS).bit_length()))
    rest = bits - (ranges.bit_length() - 1)
    width, shift = -(-rest // 8), 64 - bits

    def give(names, keys, gain, of, seen, totals) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = [(names[k], None, None, int(t)) for k, t in zip(seen.tolist(), totals.tolist(), strict=True)]
        short = keys >> np.uint64(shift)
        for code in np.unique(of).tolist():
            own = of == code
            key, first = np.unique(short[own], return_index=True)
            sums = np.add.reduceat(gain[own], first)
            place = (key >> np.uint64(rest)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            inner = key & np.uint64((1 << rest) - 1)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                rows.append((names[code], int(place[a]), _packed(inner[a:b], sums[a:b], width), b - a))
        if not rows:  # a shard without words
            return
        columns = list(zip(*rows, strict=True))
        yield from _sliced(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["lang", "place", "blob", "n"]), 1 << 12)

    found = written(_found(docs, pick, longest, sizes, support, shard_bytes, give, "lang string, place int, blob binary, n long"))
    hidden = {r.lang: r.n for r in found.where("place is null and n > 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # LANGUAGES at most

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(blob, n, width) for blob, n in zip(pdf["blob"], pdf["n"], strict=True)]
        keys, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, gain = keys[order], gain[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        enough = np.add.reduceat(gain, first) + hidden.get(pdf["lang"].iloc[0], 0) >= support
        base = np.uint64(int(pdf["place"].iloc[0]) << rest)
        return pd.DataFrame({"key": (keys[first][enough] | base).view(np.int64)})

    packs = found.where("place is not null").groupBy("lang", "place")
    return written(packs.applyInPandas(added, "key long").distinct()), shift


HELD_KEYS = 1 << 19  # phrases that a task counts before it gives them out


def _counted_exactly(docs: DataFrame, filters, longest: int, shard_bytes: int) -> DataFrame:
    """(lang, phrase, a): phrases of 2 to `longest` words that the filter of their length (a pair of bits and shift) lets
    through, and their exact counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {k: Filter(*f) for k, f in filters.value.items()}
        shards, hashes, langs, found = _Shards(shard_bytes, longest), [], [], []
        # What the task holds, in order of keys: key, language and count; and the phrases.
        held, phrases = [np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)], pa.array([], pa.string())

        def out() -> Iterator[pa.RecordBatch]:
            order = pc.sort_indices(phrases)  # equal beginnings side by side: a shuffle file is half as large
            names = pa.array(shards.names(), pa.string())
            yield from _sliced(pa.RecordBatch.from_arrays([names.take(pa.array(held[1]).take(order)), phrases.take(order), pa.array(held[2]).take(order)], ["lang", "phrase", "n"]))

        for block, ends in shards(batches):
            for k in range(2, longest + 1):
                at = np.flatnonzero(block.whole[k])
                at = at[look[k].has(block.hashes[k][at])]
                hashes.append(block.hashes[k][at])
                langs.append(block.lang[at])
                keys, first = np.unique(hashes[-1], return_index=True)
                new = ~contains(held[0], keys)
                if new.any():
                    found.append((keys[new], block.texts(k, at[first[new]])))
            if not ends:
                continue
            keys, counts, of = _counted(hashes, langs)
            known = contains(held[0], keys)
            held[2][np.searchsorted(held[0], keys[known])] += counts[known]
            if found:
                each, once = np.unique(np.concatenate([f[0] for f in found]), return_index=True)  # those that aren't held yet
                texts = pa.concat_arrays([f[1] for f in found]).take(pa.array(once))
                order = np.argsort(np.concatenate([held[0], each]), kind="stable")
                new = (each, of[~known], counts[~known])
                held = [np.concatenate([x, y])[order] for x, y in zip(held, new, strict=True)]
                phrases = pa.concat_arrays([phrases, texts]).take(pa.array(order))
            hashes, langs, found = [], [], []
            if len(held[0]) >= HELD_KEYS:
                yield from out()
                held, phrases = [x[:0] for x in held], phrases.slice(0, 0)
            pa.default_memory_pool().release_unused()
        yield from out()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _with_parts(found: DataFrame) -> DataFrame:
    """found(lang, phrase, a) with the phrase's key, the keys of what is before each cut (firsts), behind it (rests), and of
    the shorter phrases of two words or more inside (inner)."""

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), long_array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, "phrase", BLOCK):
            codes = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
            salts = np.array([_salt(x) for x in codes.dictionary.to_pylist()], np.uint64)
            block = Words(data, off, codes.indices.to_numpy(), salts, LONGEST)
            words = np.diff(block.first)
            for k in np.unique(words).tolist():
                own = np.flatnonzero(words == k)
                at = block.first[own]
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(own)).columns, long_array(block.hashes[k][at]), *map(lists, block.parts(k, at))], ["lang", "phrase", "a", "key", "firsts", "rests", "inner"])

    return found.select("lang", "phrase", "a").mapInArrow(run, "lang string, phrase string, a long, key long, firsts array<long>, rests array<long>, inner array<long>")


# ------------------------------------------------------------------ the operator


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of docs: (key, lang, a, phrase, firsts, rests, inner) of 2 to `longest` words, (key, a) of
    words, and (lang, n) with the words of each language. All are written tables."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    send = spark.sparkContext.broadcast
    words = _words_of(texts, support, shard_bytes)
    totals = words.where("key is null").select("lang", F.col("gain").alias("n"))
    frequent = words.where("key is not null").select("key", F.col("gain").alias("a"))
    sizes = {r.lang: r.n for r in totals.where("n > 0").orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    sizes = sizes or {"": 1}
    one = send(filter_of(frequent))

    def pairs(b: Words) -> list[tuple[int, np.ndarray]]:
        ok = Filter(one.value).has(b.hashes[1])
        return [(2, np.flatnonzero(b.whole[2] & ok[:-1] & ok[1:]) if len(ok) else np.zeros(0, np.int64))]

    two, shift = _may_reach(texts, pairs, 2, sizes, support, shard_bytes)
    bits = filter_of(two)
    filters = {2: (bits, shift)}
    if longest > 2:
        both = send(bits)

        def longer(b: Words) -> list[tuple[int, np.ndarray]]:
            ok, out = Filter(both.value, shift).has(b.hashes[2]) & b.whole[2], []
            for k in range(3, longest + 1):
                n = max(0, len(b.lang) - k + 1)
                every = np.ones(n, bool)
                for j in range(k - 1):
                    every &= ok[j : j + n]
                out.append((k, np.flatnonzero(every)))
            return out

        more, shift_more = _may_reach(texts, longer, longest, sizes, support, shard_bytes)
        filters |= dict.fromkeys(range(3, longest + 1), (filter_of(more), shift_more))
    counted = _counted_exactly(texts, send(filters), longest, shard_bytes)
    return written(_with_parts(counted.where(F.col("a") >= support))), frequent, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, support: int = SUPPORT, inside: int = INSIDE, top: int = TOP, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language with the highest scores.

    A-Z is lower-cased; texts are split at `[.,;:!?\\x0A-\\x0D]`, pieces into words `[^\\x20\\x09]+`. A phrase of 2 to `longest`
    words that occurs a >= support times within pieces (overlaps included) is a candidate. A cut gives l and r, the
    occurrences of both sides, and the score floor(2000000 a / (l + r)); the lowest score counts, of equal ones that of the
    shortest first side. A candidate goes if its words lie inside a longer one with 100 f(longer) >= inside * a. Equal
    scores are ranked by a, then by the phrase's bytes. Null texts are empty, a null language is `und`; each row is a
    text, whatever its id. Other columns aren't read. Sums and products are decimals.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 to {LONGEST}")
    found, words, totals = phrases(docs, lang_col, text_col, support=support, longest=longest, shard_bytes=shard_bytes)
    counts = words.unionByName(found.select("key", "a"))
    cuts = found.select("key", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("cut", "x")).select("key", "a", "cut", F.col("x.firsts").alias("first"), F.col("x.rests").alias("rest"))
    cuts = cuts.join(counts.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(counts.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    whole = "decimal(19,0)"
    score = F.expr(f"(CAST(2000000 AS {whole}) * CAST(a AS {whole})) DIV (CAST(l AS {whole}) + CAST(r AS {whole}))").cast("long")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = found.select(F.explode("inner").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    rows = found.select("key", "lang", "phrase", "a").join(longer, "key", "left")
    rows = rows.where(F.col("longer").isNull() | F.expr(f"CAST(100 AS {whole}) * CAST(longer AS {whole}) < CAST({int(inside)} AS {whole}) * CAST(a AS {whole})"))
    rows = rows.join(best, "key").select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
