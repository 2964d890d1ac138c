"""Containment join: which texts hold which strings, for any number of strings, by each string's rarest q-gram.

1. A string offers up to GRAMS of its q-grams (q bytes of UTF-8, the largest q of TIERS that fits). A bitmap of bounded size, in which
   each of them sets a bit, goes to the tasks; a scan of the texts counts what hits it.
2. Each string keeps the gram that the texts hold least often; a string with a gram that no text holds is in none.
3. A second scan gives the places of the kept grams only, (gram, text) once each. They meet the strings by the gram: an equi-join,
   the keys of frequent grams dealt out over several. Every pair met is then verified on the whole text.

Neither strings nor grams are collected, only the bitmap's words; the texts are shuffled only if more pairs are met than may be broadcast.
Null and empty strings are in no text, and nothing is in a null text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.retrieval import few

TIERS = (8, 4, 2, 1)
GRAMS = 16
#: The bitmap has at least eight bits a gram, and between these powers of two.
LEAST_BITS, MOST_BITS = 16, 28
#: Bytes of text that are searched at once.
CHUNK = 1 << 20
#: (gram, text) rows of one gram from which on its key is dealt out.
HOT = 1 << 18
#: Pairs of a text's and a string's key that are broadcast to the texts; beyond it texts and pairs are shuffled.
PAIRS_SENT = 500_000

_U = np.uint64
_SPOT = T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position on, as one number."""
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, _U)
    for k in range(q):
        out |= data[k : k + n].astype(_U) << _U(8 * k)
    return out


def slots(gram: np.ndarray, q: int, bits: int) -> np.ndarray:
    x = (gram + _U(q)) * _U(0x9E3779B97F4A7C15)
    return ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - bits)


def _offered(strings: DataFrame) -> DataFrame:
    """string, tier, gram: the grams each distinct string offers."""
    schema = T.StructType([T.StructField("string", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tier, gram = [], [], []
            for k, s in enumerate(batch.column(0).to_pylist()):
                data = np.frombuffer(s.encode(), np.uint8)
                q = next(q for q in TIERS if q <= len(data))
                found = np.unique(grams(data, q))
                found = found[np.unique(np.linspace(0, len(found) - 1, GRAMS).astype(int))]
                at += [k] * len(found)
                tier += [q] * len(found)
                gram.append(found)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(tier, pa.int32()), pa.array(np.concatenate(gram).view(np.int64))], ["string", "tier", "gram"])

    return strings.mapInArrow(run, schema)


def _bitmap(keys: DataFrame, bits: int) -> Broadcast:
    """A bit for each (tier, gram); 2**bits in all, whatever the number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tier, gram = (c.to_numpy() for c in batch.columns)
            slot = np.zeros(len(gram), _U)
            for q in TIERS:
                slot[tier == q] = slots(gram[tier == q].view(_U), q, bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> _U(6)).astype(np.int64)), pa.array((_U(1) << (slot & _U(63))).view(np.int64))], ["word", "bit"])

    words = np.zeros(1 << (bits - 6), np.int64)
    for r in keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        words[r.word] = r.bit
    return keys.sparkSession.sparkContext.broadcast(words.view(_U))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their texts' bytes in one array, and where each text ends in it."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
            at = to


def _hits(data: np.ndarray, ends: np.ndarray, q: int, bits: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number of the text) of the positions whose gram is in the bitmap and lies within one text."""
    gram = grams(data, q)
    slot = slots(gram, q, bits)
    at = np.flatnonzero((words[slot >> _U(6)] >> (slot & _U(63))) & _U(1))
    of = np.searchsorted(ends, at, side="right")
    within = at + q <= ends[of]
    return gram[at[within]], of[within]


def _once(gram: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (gram, text) once, sorted."""
    order = np.lexsort((of, gram))
    gram, of = gram[order], of[order]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))) if len(gram) else np.empty(0, bool)
    return gram[new], of[new]


def _counts(docs: DataFrame, text: str, tiers: list[int], bits: int, bitmap: Broadcast) -> DataFrame:
    """tier, gram, n: in how many texts each gram of the bitmap is, combined in the tasks."""
    rows = docs.select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in _chunks(batches, 0):
            for q in tiers:
                gram, n = np.unique(_once(*_hits(data, ends, q, bits, bitmap.value))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), q, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["tier", "gram", "n"])

    return rows.mapInArrow(run, _SPOT).groupBy("tier", "gram").agg(F.sum("n").alias("n"))


def _spots(docs: DataFrame, doc_id: str, text: str, tiers: list[int], bits: int, bitmap: Broadcast) -> DataFrame:
    """tier, gram and the id of every text that holds the gram."""
    rows = docs.select(doc_id, text)
    schema = T.StructType([*_SPOT.fields[:2], rows.schema[doc_id]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in _chunks(batches, 1):
            for q in tiers:
                gram, of = _once(*_hits(data, ends, q, bits, bitmap.value))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), q, np.int32)), pa.array(gram.view(np.int64)), batch.column(0).take(pa.array(of))], schema.names)

    return rows.mapInArrow(run, schema)


def containing(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, wanted: str) -> DataFrame:
    """doc_id, item_id: every pair of a text and an item whose string it holds, once for each pair of ids. Ids are not null."""
    strings = items.where(F.col(wanted) != "").select(F.col(wanted).alias("string")).distinct()
    offered = _offered(strings).cache()
    n, tiers = offered.count(), sorted(r.tier for r in offered.select("tier").distinct().collect())
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))
    counts = _counts(docs, text, tiers, bits, _bitmap(offered.select("tier", "gram"), bits))
    keyed = offered.join(counts, ["tier", "gram"], "left").groupBy("string").agg(F.min_by(F.struct("tier", "gram", "n"), F.struct(F.coalesce("n", F.lit(0)), -F.col("tier"), "gram")).alias("k"))
    keyed = keyed.where("k.n IS NOT NULL").select("string", "k.tier", "k.gram", F.ceil(F.col("k.n") / HOT).cast("int").alias("parts")).cache()
    kept = keyed.select("tier", "gram").distinct()
    spots = _spots(docs, doc_id, text, tiers, bits, _bitmap(kept, bits))
    if few(keyed):
        met = spots.join(F.broadcast(keyed), ["tier", "gram"])
    else:
        dealt = kept.join(keyed.groupBy("tier", "gram").agg(F.max("parts").alias("parts")), ["tier", "gram"])
        hot = dealt.where("parts > 1")
        sent = F.broadcast(hot) if few(hot, PAIRS_SENT) else hot
        salted = spots.join(sent, ["tier", "gram"], "left").withColumn("part", F.pmod(F.xxhash64(doc_id), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        met = salted.join(keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["tier", "gram", "part"])
    pairs = met.select(F.col(doc_id).alias("_doc"), "string").cache()
    sent = F.broadcast(pairs) if few(pairs, PAIRS_SENT) else pairs
    held = docs.select(doc_id, text).join(sent, F.col(doc_id) == F.col("_doc")).where(F.contains(text, "string")).select(doc_id, "string")
    owners = items.select(item_id, F.col(wanted).alias("string"))
    return held.join(F.broadcast(owners) if few(owners) else owners, "string").select(doc_id, item_id).distinct()
