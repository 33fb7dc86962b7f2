"""Chat formatting with offset-aligned loss masks (operator 6).

A conversation is rendered whole; its markers are special tokens, so no token crosses the edge of a turn. The text is
encoded once with offsets, and the sorted spans of the assistant's texts meet the token starts by binary search. Spans and
offsets are positions in the UTF-8 bytes of the rendered text. A block of conversations is one buffer: it is encoded in
one call, and one search gives all of its masks.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches

#: The markers of the template: before a role, between role and text, after a text.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SEGMENT = 1 << 20  # characters after which a long conversation goes on in a further row, between two turns
FORMATTED = "conv_id long, segment int, formatted string, input_ids array<int>, loss_mask array<boolean>, token_start array<int>, token_end array<int>"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL) if "\\" in s else s


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    found = []
    for turn in formatted.split(TURN)[1:]:
        role, text = turn.split(TEXT, 1)
        found.append((unescape(role), unescape(text.rpartition(END)[0])))
    return found


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The rendered text in UTF-8, and the spans of the texts under the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}".encode(), escape(text).encode()
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END.encode()]
        at += len(head) + len(body) + len(END)
    return b"".join(parts), spans


class Encoder:
    """A tokenizer with the markers as special tokens behind its vocabulary, and byte offsets of its tokens.

    The tokens of a byte-level vocabulary are the text's bytes in order, so their lengths give the offsets. Where lengths
    don't add up to the text, and for other vocabularies, the tokenizer's own offsets are taken.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([TURN, TEXT, END])
        special = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # A byte-level token writes each byte as one character.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(special[k].content.encode()) if k in special else len(token)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end bytes of all tokens (in the joined texts), and the number of tokens of each text."""
        strings, sizes = [t.decode() for t in texts], np.array([len(t) for t in texts], np.int64)
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        ids = [np.array(e.ids, np.int32) for e in found]
        counts = np.array([len(x) for x in ids], np.int64)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.cumsum(self.lengths[ids])
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        if np.array_equal(last, np.cumsum(sizes)):
            return ids, ends - self.lengths[ids], ends, counts
        return self._with_own_offsets(strings, np.cumsum(sizes) - sizes)

    def _with_own_offsets(self, strings: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, starts, ends, counts = [], [], [], []
        for text, first, e in zip(strings, base, self.tokenizer.encode_batch(strings, add_special_tokens=False), strict=True):
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            byte = first + np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
            at = np.array(e.offsets, np.int64).reshape(-1, 2)
            ids.append(np.array(e.ids, np.int32))
            starts.append(byte[at[:, 0]])
            ends.append(byte[at[:, 1]])
            counts.append(len(at))
        return np.concatenate(ids), np.concatenate(starts), np.concatenate(ends), np.array(counts, np.int64)


def mask_of(starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens that begin in a span; starts and spans are sorted."""
    edges = np.searchsorted(starts, spans.reshape(-1, 2), side="left")
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, edges[:, 0], 1)
    np.add.at(step, edges[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _format(path: str, loss_role: str):
    names = [x.split()[0] for x in FORMATTED.split(", ")]

    def run(batches):
        encoder, held = Encoder(path), []

        def block():
            convs, segments, texts, spans = zip(*(c[:2] + render(c[2], loss_role) for c in held), strict=True)
            ids, starts, ends, counts = encoder.encode(list(texts))
            base = np.cumsum([0, *map(len, texts)])
            every = np.array([(base[k] + a, base[k] + b) for k, own in enumerate(spans) for a, b in own], np.int64)
            mask, shift = mask_of(starts, every), np.repeat(base[:-1], counts)
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [pa.array(convs, pa.int64()), pa.array(segments, pa.int32()), texts, _lists(ids, counts), _lists(mask, counts), _lists((starts - shift).astype(np.int32), counts), _lists((ends - shift).astype(np.int32), counts)]
            return pa.RecordBatch.from_arrays(columns, names)

        conv, segment, turns, size, waiting, begun = None, 0, [], 0, 0, False
        for batch in batches:
            for own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and (own != conv or size > SEGMENT):
                    held.append((conv, segment, turns))
                    segment, turns, size = (segment + 1 if own == conv else 0), [], 0
                    if waiting > SEGMENT:
                        yield block()
                        held, waiting = [], 0
                conv, begun = own, True
                turns.append((role or "", text or ""))
                size += len(turns[-1][1])
                waiting += len(turns[-1][1])
        if turns:
            held.append((conv, segment, turns))
            yield block()

    return run


def format_conversations(conversations: DataFrame, tokenizer_path: str, *, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, segment, formatted, input_ids, loss_mask, token_start, token_end) of conversations(conv_id, turn,
    role, text). token_start and token_end are byte positions in formatted.

    Rows of a conversation follow turn, then role and text (nulls first); repeated rows are repeated turns. Null texts
    and roles are empty, a null conv_id is a conversation. A conversation streams through its task turn by turn; a
    very long one goes on in further segments, so no task holds more than about 1 MB of its text at once beyond its
    longest turn. Extra columns aren't read; no rows give no rows.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(tokenizer_path, loss_role), FORMATTED)


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end byte of each run of tokens under the mask."""
    mask, start, end = (batch.column(k) for k in (4, 5, 6))
    off = mask.offsets.to_numpy().astype(np.int64)
    on = np.concatenate([[False], mask.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], [False]])
    off = off - off[0]
    first, last = on[1:-1] & ~on[:-2], on[1:-1] & ~on[2:]
    # A run ends with its row.
    inner = off[(off > 0) & (off < len(first))]
    first[inner] |= on[1:-1][inner]
    last[inner - 1] |= on[1:-1][inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    flat = lambda x: x.values.to_numpy()[x.offsets[0].as_py() :]
    return np.searchsorted(off, a, side="right") - 1, flat(start)[a], flat(end)[b]


def _digest(batches):
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    conv, state = None, None

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def closed():
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for batch in batches:
        if not batch.num_rows:
            continue
        out, (row, start, end) = [], _runs(batch)
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        start, end = start.tolist(), end.tolist()
        for k, (own, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True)):
            if state is None or own != conv:
                if state is not None:
                    out.append(closed())
                conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = raw.decode()
            turns = turns_of(formatted)
            state[0] += len(turns)
            state[1].update("".join([f"{role}\n{text}\n" for role, text in turns]).encode())
            for i in range(cut[k], cut[k + 1]):
                text = unescape(raw[start[i] : end[i]].decode())
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if out:
            yield table(out)
    if state is not None:
        yield table([closed()])


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what
    format_conversations gives (its partitions hold whole conversations in order)."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
