"""Words of many texts at once from Arrow's own buffers, and lists of small integers as bytes.

A text column is cut into blocks of bounded size; a block's words are found with a constant number of passes over its
bytes and told apart exactly by Arrow's dictionary encoding, never with a Python step a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about `limit` bytes of text; a longer text is a batch of its own. Null texts become ''."""
    held, size = [], 0
    for batch in batches:
        text = batch.column(column).cast(pa.large_string()).fill_null("")
        batch = batch.set_column(column, batch.schema.names[column], text)
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        at = 0
        while at < len(text):
            to = int(np.searchsorted(ends, ends[at] + limit - size, side="right")) - 1
            to = max(to, at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to] - ends[at])
                at = to
            if at < len(text):
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], batches[0].schema.names)


class Words:
    """Words of a block: `names` (distinct, as binary), `codes` (of each word in turn) and `counts` (words of each text)."""

    __slots__ = ("names", "codes", "counts")

    def __init__(self, texts: pa.LargeStringArray, letters: np.ndarray):
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
        ends = ends - ends[0]
        gap = int(np.flatnonzero(~letters)[0])  # between texts
        data = LOWER[np.insert(data, ends[1:], gap)]
        mask = np.zeros(len(data) + 2, dtype=bool)
        mask[1:-1] = letters[data]
        edge = np.flatnonzero(mask[1:] != mask[:-1])
        start, end = edge[0::2], edge[1::2]
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        packed = data[mask[1:-1]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        self.names = words.dictionary
        self.codes = words.indices.to_numpy(zero_copy_only=False)
        self.counts = np.diff(np.searchsorted(start, ends + np.arange(n + 1)))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes, seven bits each, low ones first; and where each begins, with the end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    at = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k if k else slice(None)
        part = (v[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at[:-1][has] + k] = part.astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out, at


def packed(values: np.ndarray) -> bytes:
    return pack(values)[0].tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The integers of pack()."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 0x80)
    if len(last) == len(b):
        return b.astype(np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    size = last - first + 1
    out = (b[first] & 0x7F).astype(np.uint64)
    for k in range(1, int(size.max())):
        has = np.flatnonzero(size > k)
        out[has] |= (b[first[has] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)
