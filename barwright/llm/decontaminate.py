"""Benchmark decontamination by a generalised suffix automaton (operator 9).

The automaton of the benchmark's words (all items, one automaton) is small and goes to the tasks; documents stream
through it, and at each word the longest run that ends there and occurs in the benchmark is known. A word is hit
if a whole window of an item (10 words, or a shorter item as a whole) covers it.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, buffer_of, contains, free_names, small_batches, word_hashes, word_spans, written

WINDOW = 10
BENCHMARK_BYTES = 4 << 20  # benchmark text in one automaton (45 MB in a task, 10 s and 330 MB to build); a larger benchmark takes several passes with the same results
SHAPE = "n_words long, spans array<struct<start:long,end:long>>, items array<long>, bytes array<struct<start:long,end:long>>"


class _Builder:
    """An automaton that grows word by word. Most states have one way on, which lies in arrays; further ones are in a
    table of (state, word), and listed for each state."""

    def __init__(self, n_words: int):
        self.n_words = max(1, n_words)
        self.length, self.link, self.word, self.to, self.head = (array("i", [x]) for x in (0, -1, -1, -1, -1))
        self.more: dict[int, int] = {}
        self.more_word, self.more_next = array("i"), array("i")

    def new(self, length: int, word: int = -1, to: int = -1) -> int:
        for column, x in ((self.length, length), (self.link, 0), (self.word, word), (self.to, to), (self.head, -1)):
            column.append(x)
        return len(self.link) - 1

    def step(self, s: int, w: int) -> int:
        return self.to[s] if self.word[s] == w else self.more.get(s * self.n_words + w, -1)

    def set(self, s: int, w: int, t: int) -> None:
        if self.word[s] in (-1, w):
            self.word[s], self.to[s] = w, t
            return
        key = s * self.n_words + w
        if key not in self.more:
            self.more_word.append(w)
            self.more_next.append(self.head[s])
            self.head[s] = len(self.more_word) - 1
        self.more[key] = t

    def extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self.clone(last, w, q)
        new, p = self.new(self.length[last] + 1), last
        while p != -1 and self.step(p, w) < 0:
            self.set(p, w, new)
            p = self.link[p]
        if p != -1:
            q = self.step(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.clone(p, w, q)
        return new

    def clone(self, p: int, w: int, q: int) -> int:
        c, e = self.new(self.length[p] + 1, self.word[q], self.to[q]), self.head[q]
        while e != -1:
            other = self.more_word[e]
            self.set(c, other, self.more[q * self.n_words + other])
            e = self.more_next[e]
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.step(p, w) == q:
            self.set(p, w, c)
            p = self.link[p]
        return c


def _nearest(link: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each state the first one on its suffix path (itself included) that is wanted; the root where none is."""
    at = np.where(wanted, np.arange(len(link), dtype=np.int32), np.maximum(link, 0))
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at
        at = further


class SuffixAutomaton:
    """All substrings of the items, whose words are integers below n_words, as flat arrays: about 50 bytes a word of the items.

    word, to: the first way on from a state; more, more_to: further ones, sorted by (state, word); link: suffix links;
    length: longest string of a state; windows: the state on the suffix path that holds the last `window` words; short: the
    first of the whole short items that end in a state, a chain by `then` with lengths `size`. Windows (by state) and
    short items (by number, behind all states) have their item ids in items[first[k] : first[k + 1]].
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], n_words: int, window: int):
        b = _Builder(n_words)
        for _, words in items:
            last = 0
            for w in words.tolist():
                last = b.extend(last, w)
        self.window, self.n_words = window, b.n_words
        self.length, self.link, self.word, self.to = (np.array(x, np.int32) for x in (b.length, b.link, b.word, b.to))
        n = len(self.link)
        more = np.fromiter(b.more.keys(), np.int64, len(b.more))
        order = np.argsort(more)
        self.more, self.more_to = more[order], np.fromiter(b.more.values(), np.int32, len(b.more))[order]
        parent = np.maximum(self.link, 0)
        self.windows = _nearest(self.link, (self.length >= window) & (self.length[parent] < window))
        # Every item is read again by the finished automaton: windows that end at its words, or the whole short item.
        where, of, shorts = array("q"), array("q"), {}
        for item, words in items:
            s = 0
            for i, w in enumerate(words.tolist()):
                s = b.step(s, w)
                if i + 1 >= window:
                    where.append(int(self.windows[s]))
                    of.append(item)
            if 0 < len(words) < window:
                where.append(n + shorts.setdefault((s, len(words)), len(shorts)))
                of.append(item)
        pairs = np.unique(np.stack([np.array(where, np.int64), np.array(of, np.int64)], 1), axis=0) if len(where) else np.zeros((0, 2), np.int64)
        self.items, self.first = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(n + len(shorts) + 1)).astype(np.int32)
        # Short items of a state follow one another, the longest first, and then those of its suffix path.
        own: dict[int, list[tuple[int, int]]] = {}
        for (s, m), k in shorts.items():
            own.setdefault(s, []).append((m, k))
        self.size, self.then = np.zeros(len(shorts), np.int32), np.full(len(shorts), -1, np.int32)
        head = np.full(n, -1, np.int32)
        for s, chain in own.items():
            chain.sort(reverse=True)
            head[s] = chain[0][1]
            for (m, k), after in zip(chain, [*chain[1:], (0, -1)], strict=True):
                self.size[k], self.then[k] = m, after[1]
        up = _nearest(self.link, head >= 0)
        self.short = head[up]
        for s, chain in own.items():
            self.then[chain[-1][1]] = self.short[parent[s]]
        self.least = min([window, *self.size.tolist()])

    def scanner(self):
        """A function of the words of a run: hit spans (start, end), merged, and the numbers of what occurs."""
        length, link, word, to, more, more_to, windows, short, size, then = (memoryview(np.ascontiguousarray(x)) for x in (self.length, self.link, self.word, self.to, self.more, self.more_to, self.windows, self.short, self.size, self.then))
        window, n_words, n_states, n_more = self.window, self.n_words, len(self.link), len(self.more)

        def step(s, w):
            if word[s] == w:
                return to[s]
            key = s * n_words + w
            k = bisect_left(more, key)
            return more_to[k] if k < n_more and more[k] == key else -1

        def scan(words):
            spans, seen = [], set()
            s, n = 0, 0
            for i, w in enumerate(words):
                t = step(s, w)
                while t < 0 and s:
                    s = link[s]
                    n = length[s]
                    t = step(s, w)
                if t < 0:
                    n = 0
                    continue
                s, n, reach = t, n + 1, 0
                if n >= window:
                    seen.add(windows[s])
                    reach = window
                k = short[s]
                while k >= 0:
                    if size[k] <= n:
                        seen.add(n_states + k)
                        reach = max(reach, size[k])
                    k = then[k]
                if reach:
                    a = i + 1 - reach
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
            return spans, seen

        return scan

    def items_of(self, seen: set[int]) -> list[int]:
        """The items that hold what a scan has seen, in order."""
        if not seen:
            return []
        return np.unique(np.concatenate([self.items[self.first[k] : self.first[k + 1]] for k in seen])).tolist()


def build(items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[SuffixAutomaton, np.ndarray]:
    """The automaton of the items, and its vocabulary: sorted word hashes, whose places are the words' integers."""
    data, off = buffer_of(pa.array([x[1] or "" for x in items], pa.string()))
    starts, ends, first = word_spans(data, off, ALNUM)
    hashes = word_hashes(data, starts, ends, LOWER)
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes).astype(np.int32)
    return SuffixAutomaton([(x[0], ids[first[k] : first[k + 1]]) for k, x in enumerate(items)], len(vocabulary), window), vocabulary


def _scan(shared, every: bool):
    """(doc_id, n_words, spans, items, bytes): rows with hits, or every row. bytes: the spans as byte positions. shared is a
    list of automata with their vocabularies; a block's words are found and hashed once for all of them."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automata = [(x, v, x.scanner()) for x, v in shared.value]
        for rows, data, off in blocks(batches):
            starts, ends, first = word_spans(data, off, ALNUM)
            hashes = word_hashes(data, starts, ends, LOWER)
            found: list[list] = [[] for _ in range(rows.num_rows)]
            items: list[set] = [set() for _ in range(rows.num_rows)]
            for automaton, vocabulary, scan in automata:
                known = contains(vocabulary, hashes)
                # Runs of at least `least` words of the benchmark's vocabulary within a document; others hold no window.
                cut = known[:-1] & known[1:]
                inner = first[(first > 0) & (first < len(known))]
                cut[inner - 1] = False
                lo = np.flatnonzero(known & np.concatenate([[True], ~cut])) if len(known) else np.zeros(0, np.int64)
                hi = np.flatnonzero(known & np.concatenate([~cut, [True]])) + 1 if len(known) else lo
                keep = hi - lo >= automaton.least
                owner = np.searchsorted(first, lo, side="right") - 1
                for a, b, d in zip(lo[keep].tolist(), hi[keep].tolist(), owner[keep].tolist(), strict=True):
                    hit, seen = scan(np.searchsorted(vocabulary, hashes[a:b]).tolist())
                    found[d] += [(a + x, a + y) for x, y in hit]
                    items[d].update(automaton.items_of(seen))
            if len(automata) > 1:
                found = [_joined(x) for x in found]
            of = lambda d, x, y: {"start": x - int(first[d]), "end": y - int(first[d])}  # noqa: B023,E731
            at = lambda d, x, y: {"start": int(starts[x]) - int(off[d]), "end": int(ends[y - 1]) - int(off[d])}  # noqa: B023,E731
            spans = [[of(d, x, y) for x, y in own] for d, own in enumerate(found)]
            where = [[at(d, x, y) for x, y in own] for d, own in enumerate(found)]
            out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(spans, shape), pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(where, shape)], ["doc_id", "n_words", "spans", "items", "bytes"])
            yield out if every else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return run


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(bench: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, piece, text, size): items of more than `most` bytes cut at words into pieces of at most so many (2 * window
    words at least), each beginning with the last window - 1 words of the one before, so that no window is lost."""

    def run(batches):
        for rows, data, off in blocks(batches):
            starts, ends, first = word_spans(data, off, ALNUM)
            ids, numbers, texts = [], [], []
            for k, item in enumerate(rows.column(0).to_pylist()):
                i, stop = int(first[k]), int(first[k + 1])
                cuts = [(int(off[k]), int(off[k + 1]))] if off[k + 1] - off[k] <= most or i == stop else []
                while not cuts or (j := cuts[-1][2] if len(cuts[-1]) > 2 else stop) < stop:
                    i = i if not cuts else j - (window - 1)
                    j = min(stop, max(int(np.searchsorted(ends, starts[i] + most, side="right")), i + 2 * window))
                    cuts.append((int(starts[i]), int(ends[j - 1]), j))
                for n, (a, b, *_) in enumerate(cuts):
                    ids.append(item)
                    numbers.append(n)
                    texts.append(data[a:b].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["item_id", "piece", "text"])

    cut = bench.mapInArrow(run, "item_id long, piece int, text string")
    return cut.withColumn("size", F.octet_length("text").cast("long"))


AUTOMATA = 4  # in a task at once


def _dealt(bench: DataFrame, window: int, most: int) -> DataFrame:
    """The pieces of a benchmark with the (lane, part) that each is in: of a part, whose pieces make one automaton, the texts
    are at most `most` bytes (or one piece). Lanes hold some 64 parts; sizes are summed up along each. Written."""
    pieces = _pieces(bench, window, max(1, most // 4))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lane = F.pmod(F.xxhash64("item_id", "piece"), F.lit(1 + total // (64 * most)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lane").orderBy("item_id", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(pieces.withColumn("lane", lane).withColumn("part", F.floor(before / max(1, most - most // 4)).cast("int")))


def _merged_hits(text: DataFrame, bench: DataFrame, window: int, most: int) -> DataFrame:
    """(doc_id, n_words, spans, items, bytes) for each doc_id of text with hits, found by AUTOMATA parts at a time on the same
    text. doc_id must be a key of text's rows, and fixed."""
    spark, kind = text.sparkSession, f"doc_id {text.schema['doc_id'].dataType.simpleString()}, {SHAPE}"
    dealt, found = _dealt(bench, window, most), None
    parts = [(r.lane, r.part) for r in dealt.select("lane", "part").distinct().orderBy("lane", "part").collect()]
    for k in range(0, len(parts), AUTOMATA):
        built = []
        for lane, part in parts[k : k + AUTOMATA]:
            own = dealt.where((F.col("lane") == lane) & (F.col("part") == part)).orderBy("item_id", "piece").collect()
            built.append(build([(r.item_id, r.text) for r in own], window))
        shared = spark.sparkContext.broadcast(built)
        hits = written(text.mapInArrow(_scan(shared, False), kind))
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    both = F.transform(F.arrays_zip("spans", "bytes"), lambda x: F.struct(x["spans"]["start"].alias("start"), x["spans"]["end"].alias("end"), x["bytes"]["start"].alias("a"), x["bytes"]["end"].alias("b")))
    joined = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(both))).alias("both"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    pick = lambda a, b: F.transform("both", lambda x: F.struct(x[a].alias("start"), x[b].alias("end")))
    return joined.withColumn("both", _merged("both")).select("doc_id", "n_words", pick("start", "end").alias("spans"), "items", pick("a", "b").alias("bytes"))


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items, bytes) for each row of docs(doc_id, text): merged spans of hit words (word and
    byte positions) and the items with a window in it.

    Null, empty and wordless texts have no words and no hits, items without words no windows. Words are lower-cased
    (A-Z) runs of letters and digits, all bytes from 0x80 counting as letters. Item ids must be integers; items with
    a null id are left out, rows that repeat an id are items of one id. Documents without an id or with one that repeats
    are rows like others; extra columns of either table aren't read, and no rows give no rows. A benchmark of more than `benchmark_bytes` is
    worked through in parts, four to a pass over the texts; an item larger than a quarter of that is cut into pieces that share
    window - 1 words. Hits meet by row, so that repeated ids stay apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col("doc_id").cast("long"), "text")
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= benchmark_bytes:
        shared = spark.sparkContext.broadcast([build([(r.item_id, r.text) for r in bench.orderBy("item_id").collect()], window)])
        return text.mapInArrow(_scan(shared, True), f"doc_id long, {SHAPE}")
    rows = written(text.withColumn("_row", F.monotonically_increasing_id()))
    found = _merged_hits(rows.select(F.col("_row").alias("doc_id"), "text"), bench, window, benchmark_bytes)
    none = spark.sparkContext.broadcast([build([], window)])
    every = rows.select(F.struct("_row", F.col("doc_id").alias("id")).alias("doc_id"), "text").mapInArrow(_scan(none, True), f"doc_id struct<_row:long,id:long>, {SHAPE}").select("doc_id.*", "n_words")
    joined = every.join(found.drop("n_words").withColumnRenamed("doc_id", "_row"), "_row", "left")
    return joined.select(F.col("id").alias("doc_id"), "n_words", *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items", "bytes")))


def _merged(c: str):
    """Sorted spans (words start to end, bytes a to b) joined where their words meet."""
    last = "element_at(acc, -1)"
    return F.expr(
        f"aggregate({c}, cast(array() as array<struct<start:bigint,end:bigint,a:bigint,b:bigint>>), (acc, x) -> case when size(acc) > 0 and {last}.end >= x.start"
        f" then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end), 'a', {last}.a, 'b', greatest({last}.b, x.b)))) else concat(acc, array(x)) end)"
    )


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return matches(docs, benchmark, **options).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _cut(text: str | None, n: int, spans: list, where: list, most_words: int, most_share: float) -> tuple[str | None, bool]:
    """text without the byte spans `where`, and whether its hit words go beyond the limits."""
    if not spans:
        return text, False
    raw, parts, last = text.encode(), [], 0
    for x in where:
        parts.append(raw[last : x["start"]])
        last = x["end"]
    sizes = [x["end"] - x["start"] for x in spans]
    return b"".join([*parts, raw[last:]]).decode(), sum(sizes) > most_share * n or max(sizes) > most_words


def _without(shared, gone: str, most_words: int, most_share: float):
    """Rows without the byte spans that _scan finds; `gone` marks documents beyond the limits. All columns pass."""
    scan = _scan(shared, True)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["doc_id", "text"])
            cut = []
            for found in scan(iter([rows])):
                for k, n, spans, where in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), found.column(2).to_pylist(), found.column(4).to_pylist(), strict=True):
                    cut.append(_cut(batch.column(at)[k].as_py(), n, spans, where, most_words, most_share))
            yield _replaced(batch, names, gone, cut)

    return run


def _without_found(gone: str, most_words: int, most_share: float):
    """The same with hits found before, in the last three columns: number of words, spans and bytes."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-3]
            texts, *hits = (batch.column(k).to_pylist() for k in (names.index("text"), -3, -2, -1))
            yield _replaced(batch, names, gone, [_cut(t, n, spans or [], where or [], most_words, most_share) for t, n, spans, where in zip(texts, *hits, strict=True)])

    return run


def _replaced(batch: pa.RecordBatch, names: list[str], gone: str, cut: list[tuple[str | None, bool]]) -> pa.RecordBatch:
    columns = [pa.array([t for t, _ in cut], pa.string()) if name == "text" else batch.column(k) for k, name in enumerate(names)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in cut], pa.bool_())], [*names, gone])


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, most_words: int = 1000, most_share: float = 0.5, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """docs (columns as they are, whatever their names) with hit spans cut out of text; documents with a span of more than
    `most_words` words or with more than `most_share` of their words hit are dropped. Documents without hits stay byte for
    byte; so do null, empty and wordless texts. Every row is judged by its own text: ids may be null or repeat. No rows give
    no rows, no items change nothing. A benchmark of more than `benchmark_bytes` is worked through in parts on the unchanged
    texts; limits are judged and spans cut once."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gone, row, words, spans, where = free_names(docs.columns, "_gone", "_row", "_n_words", "_spans", "_bytes")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{gone}` boolean"
    if size <= benchmark_bytes:
        shared = spark.sparkContext.broadcast([build([(r.item_id, r.text) for r in bench.orderBy("item_id").collect()], window)])
        return docs.mapInArrow(_without(shared, gone, most_words, most_share), kind).where(~F.col(gone)).drop(gone)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = written(_merged_hits(rows.select(F.col(row).alias("doc_id"), "text"), bench, window, benchmark_bytes))
    hits = hits.select(F.col("doc_id").alias(row), F.col("n_words").alias(words), F.col("spans").alias(spans), F.col("bytes").alias(where))
    joined = rows.join(hits.hint("shuffle_hash"), row, "left").select(*docs.columns, words, spans, where)
    return joined.mapInArrow(_without_found(gone, most_words, most_share), kind).where(~F.col(gone)).drop(gone)


def hits_sha256(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
