"""Vectorised text kernels shared by the corpus operators.

Everything here works on one bounded chunk of whole texts at a time: texts are
joined into one byte buffer, and tokens, shingles and n-grams are found with a
constant number of passes over numpy arrays, never with a Python step a token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters of text a chunk holds before it is handed on (one longer text is a chunk of its own); its arrays fit a core's cache.
CHUNK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_U)
        if size <= 1 << 22:  # tables for very long texts are not kept
            _powers[key] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64: all output bits depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] over data[:i]; range_hash() turns two of these into the hash of a range."""
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _power_table(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end]; it does not depend on where the bytes stand."""
    value = (prefix[end] - prefix[start]) * _power_table(_INVERSE, len(prefix))[start]
    return mix64(value + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _byte_class() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    for c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = True
    return table


_IS_WORD = _byte_class()


def word_mask(data: np.ndarray) -> np.ndarray:
    """True for bytes of words in UTF-8: ASCII letters and digits, and characters beyond ASCII
    but for the blocks Latin-1 punctuation, General Punctuation and CJK punctuation."""
    mask = _IS_WORD[data]
    lead = data == 0xC2
    if lead.any():
        at = np.flatnonzero(lead)
        mask[at] = False
        mask[np.minimum(at + 1, len(data) - 1)] = False
    for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data[:-2] == first) if len(data) > 2 else np.empty(0, np.int64)
        at = at[np.isin(data[at + 1], seconds)] if len(at) else at
        for k in range(3):
            mask[at + k] = False
    return mask


class Tokens:
    """Words of a chunk of texts: 64-bit hash of each word, and where each text's words begin."""

    __slots__ = ("hashes", "first")

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        mask = word_mask(data)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        self.hashes = range_hash(prefix_hash(data), start, end) if len(start) else np.empty(0, _U)
        ends = np.cumsum(lengths)
        self.first = np.concatenate(([0], np.searchsorted(start, ends)))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def spaced_hash(words: np.ndarray, offsets: Iterable[int], seed: int = 0) -> np.ndarray:
    """Hash of the words at the given offsets from each position; len(words) - span + 1 values."""
    offsets = list(offsets)
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.empty(0, _U)
    out = np.full(n, seed + 1, dtype=_U)
    for o in offsets:
        out = out * _U(0xD1342543DE82EF95) + words[o : o + n]
    return mix64(out)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of `width` words; a shorter text that has words is one shingle of all of them."""
    if 0 < len(words) < width:
        return spaced_hash(words, range(len(words)), seed=len(words))[:1]
    return spaced_hash(words, range(width))


def chunked(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about `limit` characters, each with the index of its first; null is ''."""
    begin, size, out = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if out and size + len(t) > limit:
            yield begin, out
            begin, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield begin, out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, so that the Python values alive at once stay bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class U128:
    """A strong 128-bit key of bytes as two signed longs, the form Spark compares."""

    @staticmethod
    def signed(data: bytes, seed: int = 0) -> tuple[int, int]:
        import xxhash

        d = xxhash.xxh3_128_digest(data, seed)
        return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
