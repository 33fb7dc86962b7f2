"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed with each, in pieces
of 1 KB, so that a long text leans on the dictionaries as much as a short one. The normalised difference of the
compressed sizes, together with the compression rate itself, is calibrated to a score by logistic regression on
labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PIECE = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
SAMPLE = 2000  # labelled documents of each class that are fitted on, at most
SAMPLE_BYTES = 1 << 16  # longer texts aren't fitted on (they are scored whole)


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):  # too few samples to train on: their bytes are the dictionary
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def sizes(texts: list[bytes], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Bytes of each text, compressed with the good and with the bad dictionary, and raw."""
    good, bad = map(_compressor, dictionaries)
    out = np.zeros((len(texts), 3))
    for k, t in enumerate(texts):
        a = b = 0
        for i in range(0, len(t) or 1, PIECE):
            piece = t[i : i + PIECE]
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        out[k] = a, b, len(t)
    return out


def _design(s: np.ndarray) -> np.ndarray:
    good, bad, raw = s.T
    d = np.clip((bad - good) / (raw + 16) * 20, -3, 3)
    r = np.clip(bad / (raw + 16), 0, 1.2) * 4
    return np.stack([np.ones(len(d)), d, d**2, d**3, r, r**2, r**3, d * r, d * r**2], 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x.T * (w * p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(b))
        b -= np.clip(np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * b), -5, 5)
    return b


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, bytes]
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(sizes(texts, self.dictionaries)) @ self.weights, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """A model from docs(doc_id, text) and labels(doc_id, quality 0/1).

    Fits on at most `sample` documents of each class, chosen by a hash of the id: every other one builds the
    dictionary, the rest calibrates, weighted to the share that each class has among all labels. Null labels, ids and
    texts aren't fitted on; a label that repeats counts once, one that contradicts itself in both classes. With a class missing every score is the share of class 1 (0.5 without labels).
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    rows = docs.where(F.octet_length("text") <= sample_bytes).select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    texts = {y: [r.text.encode() for r in rows if r.y == y] for y in (0, 1)}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if min(len(texts[0]), len(texts[1])) < 2:
        share = np.clip(n1 / (n0 + n1), 1e-6, 1 - 1e-6) if n0 + n1 else 0.5
        return QualityModel((b"\0" * 8, b"\0" * 8), np.array([np.log(share / (1 - share)), *[0.0] * 8]))
    dictionaries = (_dictionary(texts[1][::2]), _dictionary(texts[0][::2]))
    rest = texts[1][1::2] + texts[0][1::2]
    y = np.array([1.0] * len(texts[1][1::2]) + [0.0] * len(texts[0][1::2]))
    w = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    return QualityModel(dictionaries, _logistic(_design(sizes(rest, dictionaries)), y, w / w.mean()))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability of class 1 for every whole text; null scores as the empty text. All other
    columns pass as they are; a column of that name is replaced. Every row gives a row, whether its id is null or
    repeated; equal texts have equal scores; no rows give no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(score_col)
    at = kept.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts), pa.float64())], [*batch.schema.names, score_col])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{score_col}` double"]))
