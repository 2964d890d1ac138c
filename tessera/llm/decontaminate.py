"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over word positions: words under a 1 are hashed, words under a 0 are ignored,
so a substituted word spoils only the seeds that look at it. Every position of every test item and of
every whole training text is hashed under each mask; a training hash that is also a test hash is a
hit, and each hit fixes a diagonal (training position minus item position) along which the words of
both are compared. The longest stretch with at least `min_identity` equal words is the overlap;
stretches on nearby diagonals add up, which bridges an inserted or a dropped word.

A pair (document, item) is reported if an overlap has `min_overlap` words, or if the overlaps cover
`min_identity` of the item.

The test side is the small one: its hashes go to the tasks in blocks of at most `block_words` words of
items, one pass over the texts a block, whatever the size of the benchmark. Texts are never shuffled,
so a hot item, source or document costs no more than its own words.

No overlap is lost: where at least 80 % of 16 or more words are equal, four of them in a row are, which
the first mask hits; in shorter ones some mask fits between the substitutions (the tests try them all). Items of up
to SHORT words get three more masks for that.

A word that is repeated in both texts makes a hit of every pair of places. Their distinct diagonals are found by convolution
instead, and each diagonal is compared once.

Defined results: null and empty texts, and items, match nothing; an item of one to three words is no evidence
within a longer text and matches texts of just these words; repeated documents or items are reported
once for each row; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernel import Tokens, chunked, small_batches, spaced_hash

#: The masks; each has weight 4. The second row serves items of at most SHORT words.
MASKS = ("1111", "110101", "1011001", "11000101")
SHORT_MASKS = ("10111", "11011", "11101")
SHORT = 15
#: Words of the shortest item that a longer text can overlap.
LEAST = 4
#: Pairs of places of one hash from which on their diagonals are found by convolution.
HOT = 1 << 16
MIN_IDENTITY = 0.8
MIN_OVERLAP = 13
BLOCK_WORDS = 1_000_000
#: Diagonals at most this far apart can be one passage with words put in or left out.
DRIFT = 3
FILTER_BITS = 20

HIT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("doc_start", T.IntegerType()),
        T.StructField("doc_end", T.IntegerType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("item_end", T.IntegerType()),
        T.StructField("n_equal", T.IntegerType()),
        T.StructField("n_covered", T.IntegerType()),
        T.StructField("n_item", T.IntegerType()),
        T.StructField("identity", T.DoubleType()),
    ]
)


def _offsets(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def longest_stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest [a, b) with at least `identity` equal words that begins and ends with an equal one."""
    hits = np.flatnonzero(equal)
    if not len(hits):
        return 0, 0
    prefix = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - identity, -identity))))
    # a start wins only if its prefix sum is a new minimum; its furthest end is where the best sum from there on still reaches it
    low = prefix[hits]
    start = hits[low < np.concatenate(([np.inf], np.minimum.accumulate(low)[:-1]))]
    best_after = np.maximum.accumulate(prefix[::-1])[::-1]
    end = np.searchsorted(-best_after, -(prefix[start] - 1e-9), "right") - 1
    # unequal words at the end only lower the sum
    end = hits[np.searchsorted(hits, end - 1, "right") - 1] + 1
    k = int(np.argmax(end - start))
    return int(start[k]), int(end[k])


def differences(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The distinct at - place of two sets of positions."""
    if len(at) * len(place) <= HOT:
        return np.unique(at[:, None] - place[None, :])
    low, high = int(at.min()), int(place.max())
    x, y = np.zeros(int(at.max()) - low + 1), np.zeros(high - int(place.min()) + 1)
    x[at - low] = 1
    y[high - place] = 1
    size = 1 << (len(x) + len(y) - 2).bit_length()
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size) > 0.5) + low - high


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    return a[0] == b[0] and np.array_equal(a, b)


class Index:
    """Seeds of a block of test items: per mask a bitmap that rejects most hashes, then the sorted hashes."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS):
        self.ids = [i for i, _ in items]
        tokens = Tokens([t or "" for _, t in items]) if items else None
        self.words = [tokens.of(k).copy() for k in range(len(items))]
        self.seeds = []
        for m, mask in enumerate(masks + short_masks):
            hashes, owner, place = [], [], []
            for k, w in enumerate(self.words):
                if m < len(masks) or len(w) <= SHORT:
                    h = spaced_hash(w, _offsets(mask), m)
                    hashes.append(h)
                    owner.append(np.full(len(h), k, np.int64))
                    place.append(np.arange(len(h)))
            h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << FILTER_BITS, dtype=bool)
            bitmap[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds.append((_offsets(mask), m, bitmap, h[order], np.concatenate(owner)[order], np.concatenate(place)[order]))
        self.tiny: dict[bytes, list[int]] = {}  # items too short for a seed, by their words
        for k, w in enumerate(self.words):
            if 0 < len(w) < LEAST:
                self.tiny.setdefault(w.tobytes(), []).append(k)

    def diagonals(self, words: np.ndarray) -> np.ndarray:
        """Unique (item index, diagonal) pairs that some seed hits, in order."""
        found = []
        if len(words) < LEAST:
            whole = self.tiny.get(words.tobytes(), ()) if len(words) else ()
            return np.array([[k, 0] for k in whole], dtype=np.int64).reshape(-1, 2)
        code = lambda owner, diagonal: (owner << 32) + (diagonal + (1 << 31))
        for offsets, m, bitmap, hashes, owner, place in self.seeds:
            h = spaced_hash(words, offsets, m)
            at = np.flatnonzero(bitmap[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            left, right = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = right - left
            at, left, n = at[n > 0], left[n > 0], n[n > 0]
            if not len(at):
                continue
            if n.sum() > HOT:
                value, which, times = np.unique(left, return_inverse=True, return_counts=True)
                size = n[np.unique(left, return_index=True)[1]]
                hot = times * size > HOT
                for v, s, g in zip(value[hot], size[hot], np.flatnonzero(hot), strict=True):
                    here = at[which == g]
                    own, begin = np.unique(owner[v : v + s], return_index=True)  # places of one hash are sorted by item
                    for k, part in zip(own, np.split(place[v : v + s], begin[1:]), strict=True):
                        found.append(code(k, differences(here, part)))
                at, left, n = (x[~hot[which]] for x in (at, left, n))
            which = np.repeat(left, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            found.append(code(owner[which], np.repeat(at, n) - place[which]))
        every = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return np.stack([every >> 32, (every & 0xFFFFFFFF) - (1 << 31)], axis=1)

    def overlaps(self, words: np.ndarray, min_identity: float, min_overlap: int, pairs: np.ndarray) -> Iterator[tuple]:
        """The best overlap with each item that a text shares enough with."""
        for k, begin, end in zip(*_runs(pairs[:, 0]), strict=False):
            item, spans = self.words[k], []
            diagonals = pairs[begin:end, 1]
            inside = diagonals[(diagonals >= 0) & (diagonals <= len(words) - len(item))]
            whole = next((d for d in inside.tolist() if _same(item, words[d : d + len(item)])), None)
            if whole is not None:  # nothing is longer or more alike
                yield int(k), whole, whole + len(item), 0, len(item), len(item), len(item), len(item), 1.0
                continue
            for d in diagonals.tolist():
                a, b = max(0, -d), min(len(item), len(words) - d)
                equal = item[a:b] == words[a + d : b + d]
                s, e = longest_stretch(equal, min_identity)
                if e - s >= 2:
                    spans.append((d, a + s, a + e, int(equal[s:e].sum())))
            if not spans:
                continue
            d, s, e, same = max(spans, key=lambda x: (x[2] - x[1], x[3], -x[0]))
            covered = np.zeros(len(item), dtype=bool)
            for d2, s2, e2, _ in spans:
                if abs(d2 - d) <= DRIFT:
                    covered[s2:e2] |= item[s2:e2] == words[s2 + d2 : e2 + d2]
            n = int(covered.sum())
            if e - s >= min(min_overlap, len(item)) or n >= min_identity * len(item) - 1e-9:
                yield int(k), s + d, e + d, s, e, same, n, len(item), same / (e - s)


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each distinct value of a sorted array, and where its run begins and ends."""
    value, begin = np.unique(sorted_values, return_index=True)
    return value.tolist(), begin.tolist(), [*begin.tolist(), len(sorted_values)][1:]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks; only one block is on the driver at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    # a word takes two characters at least, with the space
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (2 * block_words))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.orderBy("item_id", "text").collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_identity: float = MIN_IDENTITY,
    min_overlap: int = MIN_OVERLAP,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row for each document row and item that overlap enough: where, in words, and how alike."""
    spark = docs.sparkSession
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in small_batches(batches):
                ids, rows = batch.column(0).to_pylist(), []
                for begin, texts in chunked(batch.column(1).to_pylist()):
                    tokens = Tokens(texts)
                    for i in range(len(texts)):
                        words = tokens.of(i)
                        pairs = index.diagonals(words)
                        if len(pairs):
                            rows += [(ids[begin + i], index.ids[k], *rest) for k, *rest in index.overlaps(words, min_identity, min_overlap, pairs)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(HIT_SCHEMA.names, r, strict=True)) for r in rows], _ARROW)

        part = pair.mapInArrow(run, HIT_SCHEMA)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], HIT_SCHEMA) if out is None else out


_ARROW = pa.schema(
    [(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int32()) for f in HIT_SCHEMA]
)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The document rows, all columns kept, that overlap no test item; decided row by row, so nulls and
    repeated ids are no matter."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text", block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in small_batches(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                for begin, texts in chunked(batch.column(at).to_pylist()):
                    tokens = Tokens(texts)
                    for i in range(len(texts)):
                        words = tokens.of(i)
                        pairs = index.diagonals(words)
                        if len(pairs) and next(index.overlaps(words, MIN_IDENTITY, MIN_OVERLAP, pairs), None):
                            keep[begin + i] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
