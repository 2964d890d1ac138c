"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: slot s keeps a word whose bit l says "some n-gram of
language l hashes here". ANDing the words of an n-gram's slots returns, in one lookup, the set of all
languages that contain it. A text's counts by language are the column sums of those masks; a filter
with density f reports an absent n-gram with probability f**k, so each count is corrected to
(count - n * f**k) / (1 - f**k). The language with the largest corrected share decides.

N-grams are runs of `width` bytes of the lower-cased UTF-8 text, whose non-letters become single
spaces. A language's filter gets the n-grams that occur in at least `MIN_DOCS` of its sample texts.

Learning: for each language the `SAMPLE_DOCS` training texts of the smallest hashed doc_id, whole texts of any
length. Their n-grams are counted and hashed in tasks; what reaches the driver are the filters' bits, at most 2**SLOT_BITS a language.
Training rows have a non-null lang and crc32(doc_id as text) mod 3 other than 1.

Defined results: null texts and texts without a letter are `und` with score 0; if nothing can be
learned, so is every text; a text too short for one n-gram (two letters) is in no learned language's share, which keep_identified rejects; ties go to the language first in the alphabet; score is the best language's
corrected share among all languages' (0 if there is none). One row comes out for each that goes in.
A null doc_id is never held out and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch
from tessera.llm.kernel import chunked, mix64, small_batches

WIDTH = 5
HASHES = 3
SLOT_BITS = 20
SAMPLE_DOCS = 400
MIN_DOCS = 2
#: Languages whose sample sizes may be broadcast.
BROADCAST_LANGS = 100_000
UNKNOWN = "und"
#: A text of which the best language knows fewer n-grams than this share is in no learned language.
MIN_SHARE = 0.15

#: Letters of any script; other numbers, such as fractions and circled ones, are none.
_LETTER = regex.compile(r"\p{L}")
_U = np.uint64

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("share", T.DoubleType()),
    ]
)

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
for _c in range(26):
    _LETTERS[0x61 + _c] = 0x61 + _c


def ngrams(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts in one array, and the index of the text each is from."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    data = _LETTERS[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    space = data == 0x20
    first = np.zeros(len(data), dtype=bool)
    first[0] = True
    first[ends[:-1]] = True
    keep = np.flatnonzero(~space | first | ~np.concatenate(([False], space[:-1])))
    data, owner = data[keep], np.searchsorted(ends, keep, "right")
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    code = np.zeros(n, dtype=_U)
    for k in range(width):
        code = (code << _U(8)) | data[k : k + n]
    inside = owner[:n] == owner[width - 1 :]
    return mix64(code[inside]), owner[:n][inside]


class Filters:
    """The bit-sliced filter: `planes` words of 64 languages a slot."""

    def __init__(self, langs: list[str], slot_bits: int = SLOT_BITS, hashes: int = HASHES):
        self.langs, self.slot_bits, self.hashes = sorted(langs), slot_bits, hashes
        self.planes = max(1, -(-len(langs) // 64))
        self.table = np.zeros((self.planes, 1 << slot_bits), dtype=_U)

    def _slots(self, grams: np.ndarray) -> list[np.ndarray]:
        step = (grams >> _U(40)) | _U(1)
        mask = _U((1 << self.slot_bits) - 1)
        return [((grams + _U(k) * step) & mask).astype(np.int64) for k in range(self.hashes)]

    def add(self, lang: str, grams: np.ndarray) -> None:
        plane, bit = divmod(self.langs.index(lang), 64)
        for s in self._slots(grams):
            self.table[plane, s] |= _U(1 << bit)

    def add_bits(self, lang: str, words: np.ndarray, bits: np.ndarray) -> None:
        """Set the slots whose bits are set in the given 64-bit words of the language's bitmap."""
        plane, bit = divmod(self.langs.index(lang), 64)
        bitmap = np.zeros(1 << (self.slot_bits - 6), dtype=_U)
        bitmap[words] = bits
        self.table[plane, np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)] |= _U(1 << bit)

    def finish(self) -> Filters:
        # one language at a time: all bits of a plane at once would be half a gigabyte on the driver
        density = [((self.table[i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(self.langs))]
        self.false_rate = np.array(density, dtype=float) ** self.hashes
        return self

    def counts(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): how many n-grams of each text each language's filter holds."""
        slots = self._slots(grams)
        out = np.zeros((n, len(self.langs)))
        for p in range(self.planes):
            mask = self.table[p][slots[0]]
            for s in slots[1:]:
                mask &= self.table[p][s]
            for bit in range(min(64, len(self.langs) - 64 * p)):
                has = (mask >> _U(bit)) & _U(1)
                out[:, 64 * p + bit] = np.bincount(owner, weights=has, minlength=n)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, share of n-grams known) of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        grams, owner = ngrams(texts)
        total = np.bincount(owner, minlength=len(texts))[:, None].astype(float)
        known = (self.counts(grams, owner, len(texts)) - total * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        share = np.clip(known / np.maximum(total, 1), 0, 1)
        best, every = share.argmax(axis=1), share.sum(axis=1)
        out = []
        for i, t in enumerate(texts):
            if not _LETTER.search(t):
                out.append((UNKNOWN, 0.0, 0.0))
            else:
                top = float(share[i, best[i]])
                out.append((self.langs[best[i]], top / every[i] if every[i] else 0.0, top))
        return out


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_langs: int | None = None) -> Filters:
    """Learn from the training fold of doc_id, text, lang. The sample is bounded, and so is what is collected."""
    key = F.xxhash64("doc_id")
    fold = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    # a threshold on the hash keeps about twice the sample before the exact cut is taken; a row a language
    sizes = fold.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = Scratch(docs.sparkSession).save(sizes if max_langs is None else sizes.limit(max_langs), "languages")
    part = (2 * sample_docs + 100) / F.col("n")
    limits = sizes.select("lang", F.least("n", F.lit(sample_docs)).alias("n"), F.when(part >= 1, F.lit(2**63 - 1)).otherwise((part * 2.0**64 - 2.0**63).cast("long")).alias("limit"))
    near = fold.join(F.broadcast(limits) if sizes.count() <= BROADCAST_LANGS else limits, "lang").where(key <= F.col("limit")).select("doc_id", "lang", "text", "n")
    order = Window.partitionBy("lang").orderBy(key, "doc_id", "text")
    sample = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).select("lang", "n", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for begin, part in chunked(batch.column(2).to_pylist()):
                grams, owner = ngrams(part)
                if len(grams):
                    found = np.unique(np.stack([owner.astype(_U), grams], axis=1), axis=0)
                    own = pa.array(found[:, 0].astype(np.int64) + begin)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(found[:, 1].view(np.int64))], ["lang", "n", "gram"])

    grams = sample.mapInArrow(run, "lang string, n long, gram long").groupBy("lang", "n", "gram").agg(F.count("*").alias("times"))
    grams = grams.where(F.col("times") >= F.least(F.lit(MIN_DOCS), F.col("n")))
    # the same slots as Filters._slots: sums of low bits, which can't overflow
    mask = F.lit((1 << SLOT_BITS) - 1)
    step = F.shiftrightunsigned("gram", 40).bitwiseOR(F.lit(1)).bitwiseAND(mask)
    slots = F.array(*[(F.col("gram").bitwiseAND(mask) + step * k).bitwiseAND(mask) for k in range(HASHES)])
    slots = grams.select("lang", F.explode(slots).alias("slot"))
    bits = slots.groupBy("lang", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits"))
    filters = Filters([r.lang for r in sizes.select("lang").collect()])
    found: dict[str, tuple[list, list]] = {}
    for r in bits.toLocalIterator():
        words, values = found.setdefault(r.lang, ([], []))
        words.append(r.word)
        values.append(r.bits)
    for lang, (words, values) in found.items():
        filters.add_bits(lang, np.array(words), np.array(values, dtype=np.int64).view(_U))
    return filters.finish()


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, share for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [p for _, texts in chunked(batch.column(2).to_pylist()) for p in shared.value.predict(texts)]
            lang, score, share = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], RESULT.names
            )

    return rows.mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, filters: Filters, min_share: float = MIN_SHARE, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text is in a learned language; `und` and texts of which too
    few n-grams are known in any language go."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [p for _, texts in chunked(batch.column(at).to_pylist()) for p in shared.value.predict(texts)]
            yield batch.filter(pa.array([lang != UNKNOWN and share >= min_share for lang, _, share in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
