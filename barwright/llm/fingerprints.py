"""Document fingerprints from closed syncmers (operator 5): DataFrame functions only.

A k-mer is a run of 4 words, its inner substrings are the 3 runs of 2 words. It is a closed syncmer if the smallest
hash of the inner ones lies at its first or last place; that depends on nothing around it, so equal passages give
equal anchors wherever they stand. The fingerprint is the smallest 64 anchor hashes of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import place_in
from .common import free_names, small_side, written

ANCHORS = 64
_SPACE = " \t\n\x0b\f\r"


def _closed(df: DataFrame, text: str, words: str, runs: str) -> tuple[DataFrame, Column]:
    """df with the words of a text and the hashes of its runs of 2, and an array of the anchor at each word or null."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    df = df.withColumn(words, F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumn(runs, F.transform(words, lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1))))
    run = lambda i: F.get(F.col(runs), i)
    last = F.size(words) - 4
    return df, F.transform(runs, lambda x, i: F.when((i <= last) & (F.least(x, run(i + 2)) <= run(i + 1)), F.xxhash64(x, run(i + 2))))


def with_anchors(df: DataFrame, text: str, out: str, anchors: int = ANCHORS) -> DataFrame:
    """df with `out`: the sorted smallest anchor hashes of the column `text`.

    A null, empty or wordless text has none; one without a closed syncmer (always if it has fewer than 4 words) has
    the hash of its words as its only anchor. Every step is a column of its own, so that none is computed twice.
    """
    words, runs, found = free_names(df.columns, f"_{out}_w", f"_{out}_r", f"_{out}_s")
    df, closed = _closed(df, text, words, runs)
    df = df.withColumn(found, F.sort_array(F.array_distinct(F.array_compact(closed))))
    alone = F.when(F.get(F.col(words), F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))
    return df.withColumn(out, F.when(F.size(found) > 0, F.slice(found, 1, anchors)).otherwise(alone)).drop(words, runs, found)


def as_string(anchors: str) -> Column:
    """16 hex digits for each anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: str, b: str, anchors: int = ANCHORS) -> Column:
    """Share of anchors that two texts have in common (2 |A and B| / (|A| + |B|)), estimated from the smallest of both;
    1 for two texts without anchors."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, anchors)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(2.0 * common / (common + F.size(both)))


RANGE_BYTES = 16 << 20  # of text in a range of documents, about; a longer text is a range of its own


def with_next(df: DataFrame, key: str, columns: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """df with next_<column> of the row after each in ascending order of key; after the last comes the first.

    Rows are dealt to ranges of the key that hold about `range_bytes` of `columns[0]`: fine ranges of equal row counts are
    weighed, and joined until they reach it. The first row of each range also goes to the end of the range before. Null
    keys come first, rows of equal key follow the order of `columns`; a key with many rows is one range. Ranges are at most
    65,536, so that their list stays small; beyond 1 TB of text they hold more.
    """
    place = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    narrow = written(df.select(place.alias("k"), (F.octet_length(columns[0]) + 8).cast("long").alias("n")))  # texts are read once for it
    total = narrow.agg(F.sum("n")).first()[0] or 0
    range_bytes = max(range_bytes, total >> 16)
    fine = min(1 << 18, 4 * (1 + total // range_bytes))
    cuts = sorted(set(narrow.agg(F.percentile_approx("k", [i / fine for i in range(1, fine)] or [0.5], F.lit(max(10_000, 10 * fine)))).first()[0] or [])) if fine > 1 else []
    weighed = sorted((r.b, r.k, r.n) for r in narrow.groupBy(place_in(cuts, F.col("k")).alias("b")).agg(F.min("k").alias("k"), F.sum("n").alias("n")).collect())
    if not weighed:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    firsts, held = [weighed[0][1]], 0
    for _, k, n in weighed:
        if held and held + n > range_bytes:
            firsts.append(k)
            held = 0
        held += n
    own, at, to = free_names(df.columns, "_own", "_k", "_to")
    first = F.get(F.lit(firsts).cast("array<bigint>"), F.col(own))
    goes = lambda b, ghost: F.struct(b.cast("long").alias("b"), F.lit(ghost).alias("ghost"))
    before = F.pmod(F.col(own) - 1, F.lit(len(firsts)))
    rows = df.withColumn(at, place).withColumn(own, place_in(firsts[1:], F.col(at)))
    rows = rows.withColumn(to, F.explode(F.when(F.col(at) == first, F.array(goes(F.col(own), False), goes(before, True))).otherwise(F.array(goes(F.col(own), False)))))
    rows = rows.withColumn(own, F.col(f"{to}.b")).repartition(4 * len(firsts), own)  # tasks follow the ranges at every size, few hold two
    line = Window.partitionBy(own).orderBy(F.col(f"{to}.ghost"), at, *columns)
    rows = rows.select("*", *(F.lead(c).over(line).alias(f"next_{c}") for c in columns))
    return rows.where(~F.col(f"{to}.ghost")).drop(own, at, to)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, anchor): every closed syncmer of each row's text and the number of its first word, from 0. Texts of
    fewer than 4 words have none; rows that repeat an id give theirs each."""
    df, closed = _closed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "t", "w", "r")
    return df.select("doc_id", F.posexplode(closed).alias("word", "anchor")).where("anchor is not null")


HOT_ROWS = 10_000  # occurrences of an anchor from which on it is dealt out
HOT_ANCHORS = 65_536  # of these at most are known beforehand; others have fewer occurrences than all of them
SALTS = 64


def positional_matches(queries: DataFrame, docs: DataFrame, *, least: int = 2) -> DataFrame:
    """(query, doc_id, shift, n_anchors, first_word, last_word): passages that texts of a stated query set share with docs, as
    runs of equal anchors at one distance. shift is the place in the document less that in the query text; first_word and
    last_word are places in the query text of the first anchor's first word and the last one's last. Passages of fewer than
    `least` anchors are left out, and so are a query's with rows of its own id.

    Anchors depend on nothing around them, so a passage has the same ones wherever it stands; those of both sides meet by
    their hash and are grouped by (query, doc_id, shift). Anchors that occur HOT_ROWS times in docs are dealt to SALTS
    parts by document, the query's side being copied to each, so that a common passage is no hot key. Null ids match
    nothing; rows that repeat an id are taken together.
    """
    a = anchors(queries).where("doc_id is not null").distinct().select(F.col("doc_id").alias("query"), F.col("word").alias("at"), "anchor")
    b = written(anchors(docs).where("doc_id is not null").distinct())
    counts = b.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
    hot = written(counts.orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).select("anchor", F.lit(True).alias("hot")))
    salted = lambda df, salt: df.join(small_side(hot), "anchor", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(F.array(F.lit(0)))).withColumn("salt", F.explode("salt")).drop("hot")
    left = salted(a, F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = salted(b, F.array(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    met = left.join(right, ["anchor", "salt"]).where("query <> doc_id").select("query", "doc_id", (F.col("word") - F.col("at")).alias("shift"), "at")
    found = met.groupBy("query", "doc_id", "shift").agg(F.count("*").alias("n_anchors"), F.min("at").alias("first_word"), (F.max("at") + 3).alias("last_word"))
    return found.where(F.col("n_anchors") >= least)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs."""
    return with_anchors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "_t", "_a", anchors).select("doc_id", as_string("_a").alias("fingerprint"))


def edit_report(docs: DataFrame, *, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs(doc_id, text).

    The edited text has its last floor(n_chars / 2) characters replaced by as many first ones of the next document. Null
    texts are empty, null ids come first, rows that repeat an id follow one another in the order of their texts; a row alone
    is its own next one. Other columns aren't read; no rows give no rows.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_anchors(df, "text", "mark", anchors), "doc_id", ["text", "mark"])
    n = F.char_length("text")
    df = df.withColumn("n_chars", n.cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    df = df.select("doc_id", "n_chars", "mark", "next_mark", edited.alias("edited"))
    df = with_anchors(df, "edited", "edited_mark", anchors)
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("mark").alias("fingerprint"),
        as_string("edited_mark").alias("edited_fingerprint"),
        likeness("mark", "edited_mark", anchors).alias("near_edited"),
        likeness("mark", "next_mark", anchors).alias("near_next"),
    )
