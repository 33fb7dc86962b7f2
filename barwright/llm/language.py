"""Language identification with error-correcting output codes (operator 10).

Every language has a codeword of bits; for each bit a linear classifier over hashed byte n-grams (1 to 4) predicts it.
A text goes to the language whose codeword loses least against the bits' margins, each bit weighted by how well it
did in training; texts whose two best codewords are close are flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, mix, small_batches

BINS = 1 << 13
GRAMS = (1, 2, 3, 4)
SAMPLE = 2000  # labelled documents that are fitted on, at most
SAMPLE_BYTES = 1 << 14  # of a fitted text so many bytes at most; longer texts aren't fitted on (they are predicted whole)
AMBIGUOUS = 0.6
LETTER = regex.compile(r"\p{L}")
_ALL = np.arange(256)
#: Digits, punctuation and spaces become one byte, so that they tell nothing.
FOLD = np.where((LOWER >= 0x61) & (LOWER <= 0x7A) | (_ALL >= 0x80), LOWER, 0x20).astype(np.uint8)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1 in rows: for up to 7 languages all 2^(n-1) - 1 splits, above that 15 * log2(n) bits
    from a fixed hash, so that any two differ in about half of their bits."""
    if n <= 7:
        splits = np.arange(1, 1 << max(1, n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits = 15 * int(np.ceil(np.log2(n)))
    return np.where(mix(np.arange(n * bits, dtype=np.uint64) + np.uint64(7)).reshape(n, bits) & np.uint64(1), 1.0, -1.0)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of n-gram shares of each document, BINS columns; n-grams don't cross documents."""
    n, x = len(off) - 1, FOLD[data].astype(np.uint32)
    counts = np.zeros(n * BINS)
    owner = np.repeat(np.arange(n), np.diff(off))
    code = np.zeros(len(x), np.uint32)
    for g in range(1, max(GRAMS) + 1):
        if len(x) < g:
            break
        code = code[: len(x) - g + 1] * np.uint32(0x01000193) ^ x[g - 1 :] if g > 1 else x
        if g in GRAMS:
            h = (code * np.uint32(2654435761) + np.uint32(g * 40503)) >> np.uint32(32 - 13)
            same = owner[: len(h)] == owner[g - 1 :]
            counts += np.bincount((owner[: len(h)] * BINS + h)[same], minlength=n * BINS)
    counts = counts.reshape(n, BINS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (BINS + 1) x bits
    trust: np.ndarray  # of each bit

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and a score: the share of its likelihood."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = (self.trust * np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None] * 8, -30, 30)))).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        return loss.argmin(1), p.max(1)


def _fit(x: np.ndarray, y: np.ndarray, names: list[str], ridge: float = 3e-3) -> LanguageModel:
    code = codewords(len(names))
    target = code[y]
    # Ridge regression on margins: classes weigh alike, so that a frequent language doesn't take the others' texts.
    w = 1 / np.bincount(y, minlength=len(names))[y]
    w = w / w.sum()
    root = np.sqrt(w)[:, None]
    one = np.hstack([x, np.ones((len(x), 1), np.float32)]) * root.astype(np.float32)
    k = (one @ one.T).astype(np.float64) + ridge / len(x) * np.eye(len(x))
    weights = one.T @ np.linalg.solve(k, root * target).astype(np.float32)
    hit = (np.sign(one @ weights) == target).T @ w
    trust = np.log(np.clip(hit, 0.5 + 1e-3, 1 - 1e-3) / np.clip(1 - hit, 1e-3, 0.5 - 1e-3))
    return LanguageModel(names, code, weights, trust / trust.sum() * len(trust))


def fit_language(docs: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """A model from docs(doc_id, text, lang): at most `sample` documents, as many of each language, chosen by a hash of
    the id among those of up to sample_bytes; of a language that has none of these its 8 shortest. Rows with a null or
    empty text or a null lang aren't fitted on; rows that repeat an id are taken together.
    Other columns aren't read. Without any row every text is `und`. A sample must have 8 documents a language: more
    languages than that (250 by default) are an error that says so."""
    known = docs.where("lang is not null and octet_length(text) > 0").withColumn("_n", F.octet_length("text"))
    sizes = known.groupBy("lang").agg(F.min("_n").alias("least")).limit(1 + sample // 8).collect()
    names = sorted(r.lang for r in sizes)
    if len(names) > sample // 8:
        raise ValueError(f"more than {sample // 8} languages: they need a larger `sample`, of 8 documents each")
    if not names:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((BINS + 1, 1)), np.ones(1))
    large = F.col("lang").isin([r.lang for r in sizes if r.least > sample_bytes])
    known = known.where(large | (F.col("_n") <= sample_bytes))
    # Salted: of each language 64 parts are cut to the limit before the rest meets, so a frequent one is no hot group.
    own = known.select("doc_id", "lang", F.when(large, F.col("_n")).otherwise(0).alias("size"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).withColumn("salt", F.pmod("h", F.lit(64)))
    most = F.when(large, 8).otherwise(sample // len(names))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("size", "h", "doc_id")) <= most
    own = own.withColumn("ok", first("lang", "salt")).where("ok").withColumn("ok", first("lang")).where("ok")
    picked = own.select("doc_id", "lang").distinct()
    rows = sorted(known.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"]).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.lang, r.text))
    raw = [r.text.encode() for r in rows]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    x = np.empty((len(raw), BINS), np.float32)
    for i in range(0, len(raw), 64):
        x[i : i + 64] = features(np.frombuffer(b"".join(raw[i : i + 64]), np.uint8), off[i : i + 65] - off[i])
    at = {lang: k for k, lang in enumerate(names)}
    return _fit(x, np.array([at[r.lang] for r in rows]), names)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of docs(doc_id, text): `und` with score 0 for a null text or one without
    a letter. Of languages whose codewords are equally near the first by name is taken. Ambiguous: the best codeword has
    less than 0.6 of the likelihood. Every row gives a row, whether its id is
    null or repeated; equal texts are predicted alike; other columns aren't read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, data, off in blocks(batches, most=1 << 20):
            for a in range(0, rows.num_rows, 256):
                part = rows.slice(a, 256)
                known = np.array([bool(m.names and x and LETTER.search(x)) for x in part.column(1).to_pylist()])
                cut = off[a : a + 257]
                best, score = m.predict(features(data[cut[0] : cut[-1]], cut - cut[0])) if m.names else (np.zeros(part.num_rows, int), np.zeros(part.num_rows))
                names = [m.names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                score = np.where(known, np.nan_to_num(score), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(known & (score < AMBIGUOUS))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
