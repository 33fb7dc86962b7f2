"""N-gram Jaccard join by signature trees (operator 1).

Every document becomes the set of 64-bit hashes of its distinct 5-word shingles. Documents that can be linked
share one of the first n - ceil(0.8 n) + 1 hashes of their sets in any one order, so these hashes deal the sets into
blocks; the order puts a bounded list of frequent hashes last, which keeps blocks small. In each block a signature
tree (leaves: token bitmaps and sizes; inner nodes: bitmaps joined by OR, size ranges, largest slack) is walked
against itself: a pair of nodes whose largest possible overlap can't reach the threshold is dropped with all below
it. The pairs of leaves that remain are checked exactly unless links found before already connect them, so a block
gives a spanning forest of its links, never all pairs of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Heavy, blocks, contains, free_names, heavy_keys, long_array, mix, run_hash, small_batches, small_side, word_hashes, word_spans, written
from .graph import connected_components

WORDS = 5
PERCENT = 80
HOT_LIST = 1 << 16  # at most so many frequent hashes are put last (512 KB sent to tasks); any list gives the same links
HOT_SHARE = 1 / 1024  # a hash on this share of all documents is always a candidate for that list
BLOCK_DOCS = 2048  # a block of more sets is walked in parts
BLOCK_TOKENS = 1 << 22  # so is one whose sets hold more tokens (32 MB of hashes)
FANOUT = 8


# ------------------------------------------------------------------ sets


def shingle_sets(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each row's text."""
    for rows, data, off in blocks(batches):
        starts, ends, first = word_spans(data, off, SPACED)
        hashes = word_hashes(data, starts, ends, LOWER)
        runs, sets = run_hash(hashes, words), []
        for d in range(rows.num_rows):
            a, b = first[d], first[d + 1]
            if b - a >= words:
                sets.append(np.unique(runs[a : b - words + 1]))
            else:
                sets.append(run_hash(hashes[a:b], int(b - a), seed=int(b - a)) if b > a else np.zeros(0, np.uint64))
        yield rows, sets


def set_keys(u: np.ndarray) -> tuple[int, int]:
    """A 48-bit and a 64-bit hash of a set, which tell it apart together. Only the first goes with every first hash; sets
    that share it by chance are compared once more."""
    return int(mix(np.array([u.sum(dtype=np.uint64)]))[0]) >> 16, int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def first_hashes(u: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(percent / 100 * n) + 1 of a sorted set in the order (frequent or not, hash)."""
    most = len(u) - (percent * len(u) + 99) // 100 + 1
    late = contains(hot, u)
    return np.concatenate([u[~late], u[late]])[:most] if late.any() else u[:most]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _classes(words: int):
    """Rows kind 0: doc_id, th, n, s1, s2 of each document, and bits of the first one of each set in a task; kind 1: a
    locally frequent hash in s1, its count in n, the smallest key of a set with it in s2."""

    def run(batches):
        heavy, seen = Heavy(HOT_SHARE, 8), set()

        def frequent(found):
            if found is not None and len(found[0]):
                zero = np.zeros(len(found[0]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero + 1, pa.int32()), pa.array(zero), pa.array(zero), long_array(found[1]), long_array(found[0]), long_array(found[2]), pa.nulls(len(zero), pa.binary())], names)

        names = ["kind", "doc_id", "th", "n", "s1", "s2", "bits"]
        for rows, sets in shingle_sets(batches, words):
            keys, bits = [set_keys(u) for u in sets], []
            for k, u in zip(keys, sets, strict=True):
                bits.append(bitmap(u) if len(u) and k not in seen else None)
                if k not in seen:
                    seen.add(k)
                    yield from frequent(heavy.add(u, k[0]))
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(sets), pa.int32()), rows.column(0), rows.column(2), pa.array([len(u) for u in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([_signed(k[1]) for k in keys], pa.int64()), pa.array(bits, pa.binary())], names
            )
        yield from frequent(heavy.rest())

    return run


def _firsts(hot: np.ndarray, leaders: np.ndarray, words: int, percent: int):
    """(token, s): the first hashes of each set; equal sets of a task once.

    Tokens are hashes cut to 48 bits (two that agree in them by chance only make a block larger) with zeros behind. The
    frequent ones don't meet by hash: their blocks have leaders known beforehand, and the token of such a row is the
    leader's 48 bits, 15 bits that spread the rows, and a one.
    """

    def run(batches):
        seen = set()
        for _, sets in shingle_sets(batches, words):
            tokens, owners = [], []
            for u in sets:
                if not len(u) or (k := set_keys(u)) in seen:
                    continue
                seen.add(k)
                t = first_hashes(u, hot, percent)
                known = contains(hot, t)
                if known.any():
                    lead = np.unique(leaders[np.searchsorted(hot, t[known])]).astype(np.uint64)
                    lead = lead[lead != k[0]] << np.uint64(16) | np.uint64((k[1] & 0x7FFF) << 1 | 1)
                    t = np.concatenate([t[~known] & np.uint64(0xFFFFFFFFFFFF0000), lead])
                else:
                    t = t & np.uint64(0xFFFFFFFFFFFF0000)
                tokens.append(t)
                owners.append(np.full(len(t), k[0], np.uint64))
            if len(seen) > 1 << 20:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([long_array(np.concatenate(tokens)), long_array(np.concatenate(owners))], ["token", "s"])

    return run


def _tokens(words: int):
    """(node, tokens, deals) of each node's text: the whole set as bytes; rows that repeat id and text once in a task."""

    def run(batches):
        seen = set()
        for rows, sets in shingle_sets(batches, words):
            nodes = rows.column(2).to_pylist()
            new = [k for k, x in enumerate(nodes) if x not in seen and not seen.add(x)]
            picked = rows.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(2), pa.array([sets[k].tobytes() for k in new], pa.binary()), picked.column(3)], ["node", "tokens", "deals"])

    return run


# ------------------------------------------------------------------ signature trees


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: 1 to 2 a token, a power of two. Unrelated sets of n tokens in n bits have some
    0.77 n as their largest possible overlap (shared bits and slack), well below the 0.89 n that a link takes."""
    return max(64, 1 << max(0, n - 1).bit_length())


def bitmap(u: np.ndarray) -> bytes:
    """The token bitmap of a set; a token's bit is its hash modulo the width, so halves joined by OR give the bitmap
    of half the width."""
    width = width_of(len(u))
    bits = np.zeros(width, bool)
    bits[(u & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(raw: bytes, width: int) -> np.ndarray:
    bits = np.frombuffer(raw, np.uint64)
    while len(bits) * 64 > width:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


class SignatureTree:
    """Levels of nodes over sets: OR-joined bitmaps, smallest and largest size, largest slack (tokens that share a
    bit with another token of their set). Level 0 holds the sets themselves; they should be ordered by size."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > fanout:
            bits, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(low), fanout)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(slack, cuts)))

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of sets that can still be linked, in pieces, by a walk of the tree against itself."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][1]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 8192:
                stack += [(level, i[k : k + 8192], j[k : k + 8192]) for k in range(0, len(i), 8192)][::-1]
                continue
            bits, low, high, slack = self.levels[level]
            if level == 0:
                i, j = i[i < j], j[i < j]
            ok = 100 * np.minimum(high[i], high[j]) >= percent * np.maximum(low[i], low[j])
            i, j = i[ok], j[ok]
            step = max(1, (1 << 20) // bits.shape[1])
            shared = np.concatenate([np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])
            most = np.minimum(shared + np.minimum(slack[i], slack[j]), np.minimum(high[i], high[j]))
            ok = (100 + percent) * most >= percent * (low[i] + low[j])
            i, j = i[ok], j[ok]
            if level == 0:
                yield i, j
                continue
            n, f = len(self.levels[level - 1][1]), self.fanout
            a = (i[:, None] * f + np.repeat(np.arange(f), f)).ravel()
            b = (j[:, None] * f + np.tile(np.arange(f), f)).ravel()
            keep = (a < n) & (b < n) & (a <= b)
            if keep.any():
                stack.append((level - 1, a[keep], b[keep]))


def possible_pairs(sizes: list[int], bitmaps: list[bytes], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Pairs of sets that their bitmaps don't rule out: a tree for each width, with the sets of the next width (sizes
    more than two widths apart can't be linked) folded into it."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    by: dict[int, list[int]] = {}
    for k in order:
        by.setdefault(width_of(sizes[k]), []).append(k)
    for width, own in by.items():
        both = own + by.get(2 * width, [])
        tree = SignatureTree(np.stack([_folded(bitmaps[k], width) for k in both]), np.array([sizes[k] for k in both], np.int64))
        for i, j in tree.pairs(percent):
            first = i < len(own)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                yield both[a], both[b]


class Sets:
    """Union-find."""

    def __init__(self, n: int, known: list | None = None):
        self.up, by = list(range(n)), {}
        for k, x in enumerate(known or ()):
            self.join(k, by.setdefault(x, k))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def forest(nodes: list[int], sets: list[np.ndarray], known: list | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets; sets of equal `known` count as connected before."""
    found, links = Sets(len(sets), known), []
    for a, b in possible_pairs([len(u) for u in sets], [bitmap(u) for u in sets], percent):
        if found.root(a) == found.root(b):
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            found.join(a, b)
            links.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns; rows are sorted by these, so that one run is held at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _rows(rows: Iterator[tuple], names: list[str], types: list, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _possible(percent: int):
    """(leader, part, sub, s1, n, comp): the sets of each part that can be linked to another one; `sub` names the ones
    that can be connected."""

    def found(batches):
        for rows in _groups(batches, 2):
            known = [r[3] for r in rows]
            groups, some = Sets(len(rows)), set()
            for a, b in possible_pairs([r[4] for r in rows], [r[5] for r in rows], percent):
                if known[a] is None or known[a] != known[b]:
                    groups.join(a, b)
                    some |= {a, b}
            for k in sorted(some):
                yield rows[k][0], rows[k][1], rows[groups.root(k)][2], rows[k][2], rows[k][4], known[k]

    def run(batches):
        yield from _rows(found(batches), ["leader", "part", "sub", "s1", "n", "comp"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])

    return run


def _exact(percent: int):
    """(a, b): links of each (leader, part, sub)."""

    def found(batches):
        for rows in _groups(batches, 3):
            known = [r[3] if r[4] is None else r[4] for r in rows]
            yield from forest([r[3] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], known, percent)

    def run(batches):
        yield from _rows(found(batches), ["a", "b"], [pa.int64(), pa.int64()])

    return run


def of_like_size(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (leader, part, n, more) whose size another row of their part comes near enough to for a link. The nearest
    sizes are the neighbours in the order of sizes, so no pair that can be linked is lost."""
    line = Window.partitionBy("leader", "part").orderBy("n")
    n, before, after = F.col("n"), F.lag("n").over(line), F.lead("n").over(line)
    return rows.withColumn("_near", F.coalesce(100 * before >= percent * n, F.lit(False)) | F.coalesce(100 * n >= percent * after, F.lit(False))).where("_near").drop("_near")


def regrouped(left: DataFrame, block_docs: int, block_tokens: int) -> DataFrame:
    """left(leader, part, sub, s1, n, comp): the groups (leader, part, sub, s1, comp) to check exactly. Near copies meet in
    many blocks; groups that share a set become one, with each set once, where that is no larger than a block may be.
    It holds every pair that its groups hold. Larger ones stay as they are."""
    links = connected_components(left.select(F.col("sub").alias("a"), F.col("s1").alias("b")))
    own = left.select("s1", "n", "comp").distinct().join(links.select(F.col("node").alias("s1"), F.col("comp").alias("to")), "s1", "left").withColumn("to", F.coalesce("to", "s1"))
    size = own.groupBy("to").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    fits = (F.col("size") <= block_docs) & (F.col("tokens") <= block_tokens)
    own = written(own.join(size, "to").select("to", "s1", "comp", fits.alias("fits")).distinct())
    whole = own.where("fits").select(F.col("to").alias("leader"), F.lit("").alias("part"), F.col("to").alias("sub"), "s1", "comp")
    return whole.unionByName(left.join(own.where("not fits").select("s1").distinct(), "s1", "left_semi").select(whole.columns))


def walk_parts(parts: DataFrame, classes: DataFrame, text: DataFrame, percent: int, words: int, block_docs: int, block_tokens: int) -> DataFrame:
    """parts(leader, part, s1, comp): links (a, b) of nodes, found by the trees of all (leader, part). Only sets with others
    of like size get their bitmaps. The whole sets of those that bitmaps leave are read again, by id and text hash, and
    go to one group each wherever groups aren't too large. A text brings the groups of its set along, so whole sets move
    once; texts move once if the sets are too many to be sent to them."""
    sizes = of_like_size(parts.join(classes.select("s1", "node", "n"), "s1"), percent)
    rows = sizes.join(classes.select("node", "bits"), "node").select("leader", "part", "s1", "comp", "n", "bits").repartition("leader", "part").sortWithinPartitions("leader", "part", "s1")
    left = written(regrouped(written(rows.mapInArrow(_possible(percent), "leader long, part string, sub long, s1 long, n long, comp long")), block_docs, block_tokens))
    deals = left.groupBy("s1").agg(F.collect_list(F.struct("leader", "part", "sub", "comp")).alias("deals"))
    need = written(classes.join(deals, "s1").select(F.col("best.doc_id").alias("of"), F.col("best.th").alias("th"), "node", "deals"))
    found = text.withColumn("_th", F.xxhash64("text")).join(small_side(need, left.count()), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("_th") == F.col("th")))
    tokens = found.select("doc_id", "text", "node", "deals").mapInArrow(_tokens(words), "node long, tokens binary, deals array<struct<leader:long,part:string,sub:long,comp:long>>")
    # Two tasks can both have had the same row; a link of a node to itself is none.
    rows = tokens.select(F.explode("deals").alias("deal"), "node", "tokens").select("deal.leader", "deal.part", "deal.sub", "node", "deal.comp", "tokens").repartition("leader", "part", "sub").sortWithinPartitions("leader", "part", "sub", "node")
    return written(rows.mapInArrow(_exact(percent), "a long, b long").distinct())


# ------------------------------------------------------------------ the join


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs.

    Null, empty and wordless texts have no shingles, no links and themselves as component; texts of fewer than five
    words are one shingle. Equal sets share a class_id (its smallest id) and are linked. Rows that repeat an id count
    as one row each. Rows without an id are linked like others; class_id and component_id are null where no row of the
    class or component has an id. Other columns of docs aren't read. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(text.withColumn("th", F.xxhash64("text")).mapInArrow(_classes(words), "kind int, doc_id long, th long, n long, s1 long, s2 long, bits binary"))
    hot, leaders = heavy_keys(found.where("kind = 1").select(F.col("s1").alias("key"), "n", F.col("s2").alias("owner")), HOT_LIST)
    sets = found.where("kind = 0")
    # Equal sets are a class: a number (the row's place in the written table), its smallest id, its bitmap, and one row to
    # read it from.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")
    classes = written(sets.where("n > 0").groupBy("s1", "s2", "n").agg(best, F.min("doc_id").alias("class_id"), F.first("bits", ignorenulls=True).alias("bits")).withColumn("node", F.monotonically_increasing_id()))

    # Blocks: the sets that share a first hash, named by their leader, the smallest key. One exchange by token and an
    # order in it give each row its leader; a token that isn't known as frequent has a small share of all rows.
    firsts = text.mapInArrow(_firsts(hot, leaders, words, percent), "token long, s long")
    line = Window.partitionBy("token").orderBy("s")
    firsts = firsts.select("token", "s", F.first("s").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("low"), F.lag("s").over(line).alias("before"))
    known = F.col("token").bitwiseAND(1) == 1
    firsts = firsts.where(known | (F.col("s") != F.col("before")) & (F.col("s") != F.col("low"))).select(F.when(known, F.shiftrightunsigned("token", 16)).otherwise(F.col("low")).alias("leader"), F.col("s").alias("s1"))
    members = written(firsts.distinct().join(classes.groupBy("s1").agg(F.max("n").alias("n")), "s1"))
    sized = written(members.groupBy("leader").agg((F.count("*") + 1).alias("size"), F.sum("n").alias("tokens")))

    parts = F.greatest(F.ceil(F.col("size") / block_docs), F.ceil(F.col("tokens") / block_tokens))
    rest = members.join(sized, "leader").select("leader", F.pmod(F.xxhash64("s1"), parts).cast("string").alias("part"), "s1")
    heads = sized.select("leader", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: x.cast("string"))).alias("part"), F.col("leader").alias("s1"))
    links = walk_parts(rest.unionByName(heads).withColumn("comp", F.lit(None).cast("long")), classes, text, percent, words, block_docs, block_tokens)

    # Blocks walked in parts: sets of different components meet, until all parts have met.
    large = sized.withColumn("parts", parts).where("parts > 1")
    if not large.isEmpty():
        block = members.select("leader", "s1").unionByName(large.select("leader", F.col("leader").alias("s1")))
        across = _across(block, large, classes, connected_components(links))
        links = links.unionByName(walk_parts(across, classes, text, percent, words, block_docs, block_tokens))

    # A component is named by the smallest id of its rows; null if none of them has an id.
    linked = classes.select("s1", "s2", "n", "node", "class_id").join(connected_components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = linked.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    linked = linked.join(names, "comp").select("s1", "s2", "n", "class_id", "component_id")
    rows = sets.select("doc_id", "n", "s1", "s2").join(linked, ["s1", "s2", "n"], "left")
    alone = F.col("n") == 0
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _across(members: DataFrame, large: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """Parts for what the first walk of large blocks (leader, size, tokens, parts) hasn't compared. In a block with several
    components, the sets outside its largest component meet one another and those of the largest; a block of one
    component is done. A set is copied to as many parts as there are chunks of half a part's sets or tokens."""
    known = classes.select("s1", "node", "n").join(comps, "node", "left").select("s1", "n", F.coalesce("comp", "node").alias("comp"))
    rows = written(members.join(large.select("leader", "parts", "size", "tokens"), "leader").join(known, "s1"))
    sizes = rows.groupBy("leader", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    main = sizes.groupBy("leader").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max(F.struct("k", "comp", "t")).alias("top"), F.sum("k").alias("k_all"), F.sum("t").alias("t_all")).where("k_all > top.k")
    # Halves: of two chunks that meet, each holds half of what a part may hold.
    chunks = lambda k, t: F.greatest(F.lit(1).cast("long"), F.ceil(2 * F.col("parts") * F.greatest(k / F.col("size"), t / F.col("tokens"))))
    rows = rows.join(main, "leader").withColumn("n_rest", chunks(F.col("k_all") - F.col("top.k"), F.col("t_all") - F.col("top.t"))).withColumn("n_main", chunks(F.col("top.k"), F.col("top.t")))
    chunk = F.xxhash64("s1")
    rest = rows.where("comp <> main").withColumn("c", F.pmod(chunk, "n_rest"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair = lambda kind, x, y: F.concat_ws(":", F.lit(kind), x, y)
    with_rest = rest.select("leader", F.explode(F.transform(every("n_rest"), lambda x: pair("r", F.least(F.col("c"), x), F.greatest(F.col("c"), x)))).alias("part"), "s1", "comp").distinct()
    with_main = rest.select("leader", F.explode(F.transform(every("n_main"), lambda x: pair("m", F.col("c"), x))).alias("part"), "s1", "comp")
    of_main = rows.where("comp = main").withColumn("c", F.pmod(chunk, "n_main")).select("leader", F.explode(F.transform(every("n_rest"), lambda x: pair("m", x, F.col("c")))).alias("part"), "s1", "comp")
    return with_rest.unionByName(with_main).unionByName(of_main)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id (rows without an id last, ties by the text's hash); all columns
    stay, whatever their names. Rows are linked by their texts, also those that repeat an id or have none. Of rows without
    shingles those stay that don't repeat the id and text of another, and all without an id. No rows give no rows."""
    row, word, bits = free_names(docs.columns, "_row", "_word", "_bits")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), codec="zstd")
    found = ngram_join(rows, row).select(F.col("doc_id").alias("r"), "n_shingles", "component_id")
    key = rows.select(F.col(row).alias("r"), "doc_id", F.xxhash64("text").alias("h"))
    alone = F.col("n_shingles") == 0
    group = [F.when(~alone | F.col("doc_id").isNull(), F.col("component_id")).alias("c"), F.when(alone, F.col("doc_id")).alias("d"), F.when(alone, F.col("h")).alias("t")]
    keep = found.join(key, "r").groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "r")).alias("best")).select(F.col("best.r").alias(row))
    # A bit for each row that stays, 64 to a word: few enough to be sent to texts, which then stay where they are.
    place, bit = F.shiftright(row, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(row).bitwiseAND(63).cast("int"))
    marks = written(keep.groupBy(place.alias(word)).agg(F.bit_or(bit).alias(bits)))
    return rows.join(small_side(marks), place == F.col(word)).where(F.col(bits).bitwiseAND(bit) != 0).select(docs.columns)
