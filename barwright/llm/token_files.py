"""Token ids in Arrow files of equal-length sequences (operator 2).

A part is an Arrow IPC file of record batches with a fixed number of rows; ids and mask are fixed-size lists, so the
place of any sequence follows from its number and a memory-mapped file gives it without a copy. The tokens of a part's
documents run through its sequences without gaps; the mask ends with the last token. A second small file has the
documents' places. Parts are ranges of document ids in ascending order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import LOWER, SPACED, blocks, shared_dir, small_batches, word_spans

LENGTH = 2048  # tokens in a sequence
BATCH_ROWS = 64  # sequences in a record batch
CACHE_WORDS = 1 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space and never joins words across it; each
    distinct word is encoded once and remembered, within a bound."""

    _kept: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each worker process."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        if len(self.place) + len(words) > len(self.start):
            more = len(self.place) + len(words)
            self.start, self.count = np.concatenate([self.start, np.zeros(more, np.int64)]), np.concatenate([self.count, np.zeros(more, np.int64)])
        strings = [w.decode() for w in words]
        groups = [strings[i : i + 200] for i in range(0, len(strings), 200)]
        at = 0
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            begins = np.cumsum([0] + [len(w) + 1 for w in group[:-1]])
            owner = np.searchsorted(begins, np.array([o[0] for o in e.offsets], np.int64), side="right") - 1
            counts = np.bincount(owner, minlength=len(group)) if len(ids) else np.zeros(len(group), np.int64)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            k = len(self.place)
            self.start[k : k + len(group)] = self.used + np.cumsum(counts) - counts
            self.count[k : k + len(group)] = counts
            for i in range(len(group)):
                self.place[words[at + i]] = k + i
            self.used += len(ids)
            at += len(group)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each ended by end_id, and the number of each one's ids."""
        n_docs = len(off) - 1
        if b"<|" not in data.tobytes():  # special tokens are told apart by case
            data = LOWER[data]
        starts, ends, _ = word_spans(data, off, SPACED)
        # A final full stop or comma after a letter is a piece of its own in any case.
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        cut = ends[(ends - starts >= 2) & ((last == 0x2E) | (last == 0x2C)) & (before >= 0x61) & (before <= 0x7A)] - 1
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        owner = np.searchsorted(off, starts, side="right") - 1
        if len(starts):
            edges = np.stack([starts, ends], 1).ravel().astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
            known = pieces.dictionary.to_pylist()
            used = pieces.indices.to_numpy()[::2]
            mark = np.zeros(len(known), bool)
            mark[used] = True
            wanted = [w for w, ok in zip(known, mark, strict=True) if ok]
            if len(self.place) > CACHE_WORDS:
                self.clear()
            if new := [w for w in wanted if w not in self.place]:
                self._learn(new)
            place = np.zeros(len(known), np.int64)
            place[mark] = [self.place[w] for w in wanted]
            of = place[used]
            count = self.count[of]
            first = np.cumsum(count) - count
            ids = self.ids[np.repeat(self.start[of] - first, count) + np.arange(count.sum())]
            counts = np.bincount(owner, count, minlength=n_docs).astype(np.int64)
        else:
            ids, counts = np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts += 1
        return ids, counts


class TextEncoder:
    """Encodes whole texts; for tokenizers that join words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        end = [] if end_id is None else [end_id]
        found = [np.array(e.ids + end, np.int32) for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(off, off[1:])], add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.array([len(x) for x in found], np.int64)


def _schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _PartWriter:
    def __init__(self, sink, length: int, rows: int, wide: bool):
        self.schema, self.length, self.rows, self.kind = _schema(length, wide), length, rows, np.uint32 if wide else np.uint16
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        step = self.length * self.rows
        if self.n >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for i in range(0, whole, step):
                self._write(flat[i : i + step], step)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        padded = np.zeros(-(-n // self.length) * self.length, self.kind)
        padded[:n] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(len(padded)) < n)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._write(np.concatenate(self.held), self.n)
        self.file.close()


def _put(fs: pafs.FileSystem, path: str, attempt: int, write) -> None:
    """Writes under a name of this attempt, then renames: a lost or repeated task leaves no half file."""
    with fs.open_output_stream(own := f"{path}.{attempt}.tmp") as sink:
        write(sink)
    fs.move(own, path)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int | None = None, length: int = LENGTH, batch_rows: int = BATCH_ROWS, wide: bool | None = None, by_word: bool = False) -> list[dict]:
    """Writes docs(doc_id, text) and returns the parts in order: path, first sequence-file row count, documents, tokens.

    Null texts are empty (the end id alone). Rows that repeat an id follow one another ordered by text; null ids come
    first. `wide`: ids of 32 bits instead of 16; by default where the vocabulary or the end id needs them. `by_word`: the tokenizer never joins words across ASCII white space.
    `folder` must be a place that executors share (default: a new folder under spark.checkpoint.dir).
    """
    small_batches(docs.sparkSession)
    folder = folder or shared_dir(docs.sparkSession)
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)
    needed = max([*vocabulary.values(), end_id or 0]) > np.iinfo(np.uint16).max
    if needed and wide is False:
        raise ValueError("the vocabulary has ids above 65,535: they need wide=True")
    wide = needed if wide is None else wide

    def run(batches):
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, seen = f"{base}/part-{task.partitionId():06d}", []
        encoder = WordEncoder.of(tokenizer_path) if by_word else TextEncoder(tokenizer_path)

        def fill(sink):
            part, start = _PartWriter(sink, length, batch_rows, wide), 0
            for rows, data, off in blocks(batches):
                ids, counts = encoder.encode(data, off, end_id)
                part.add(ids)
                seen.append(pa.RecordBatch.from_arrays([rows.column(0), pa.array(start + np.cumsum(counts) - counts), pa.array(counts)], schema=_INDEX))
                start += len(ids)
            part.close()

        _put(fs, f"{path}.arrow", task.taskAttemptId(), fill)
        index = pa.Table.from_batches(seen, _INDEX)

        def places(sink):
            with pa.ipc.new_file(sink, _INDEX) as out:
                out.write_table(index, max_chunksize=1 << 16)

        _put(fs, f"{path}.index.arrow", task.taskAttemptId(), places)
        tokens = int(np.sum(index.column(2).to_numpy())) if len(index) else 0
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([f"{folder}/part-{task.partitionId():06d}"]), pa.array([len(index)]), pa.array([tokens])], ["part", "path", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long").collect()
    return [r.asDict() for r in sorted(parts)]


class TokenFile:
    """Random access to the sequences of a part; a local part is memory-mapped and read without a copy."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow"))
        self.index = pa.ipc.open_file(pa.memory_map(f"{name}.index.arrow") if local else fs.open_input_file(f"{name}.index.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence i."""
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        ids, mask = (batch.column(k).flatten()[row * self.length : (row + 1) * self.length] for k in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def tokens(self):
        """The tokens of each record batch that the mask marks."""
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            yield batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)]

    def documents(self):
        """(doc_id, start, n_tokens, pieces): the tokens of each document in order, in pieces."""
        parts, held = self.tokens(), np.zeros(0, np.uint16)
        for k in range(self.index.num_record_batches):
            for doc, start, n in zip(*(c.to_pylist() for c in self.index.get_batch(k).columns), strict=True):
                pieces, left = [], n
                while left:
                    if not len(held):
                        held = next(parts)
                    pieces.append(held[:left])
                    held, left = held[left:], left - min(left, len(held))
                yield doc, start, n, pieces


def read_token_files(spark, parts: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files. start counts the tokens of all
    documents before it; ids_crc32 is of the ids as little-endian unsigned 32-bit integers."""
    rows, base = [], 0
    for p in parts:
        rows.append((p["path"], base))
        base += p["n_tokens"]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], kind)

    def run(batches):
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for doc, start, n, pieces in TokenFile(path).documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    out.append((doc, first + start, n, crc))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "path string, base long").repartition(len(rows), "path").mapInArrow(run, kind)
