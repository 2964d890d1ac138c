"""Ranked lexical search: an inverted index in shards, and document-at-a-time evaluation of all items on each shard.

Index. Every scan task cuts its documents into shards of about `shard_bytes` of text. In a shard the documents are numbered
in the order of doc_id, and each term has one posting list in that order: gaps of numbers and term frequencies, seven bits
a byte. One more row for a shard (its term is null) holds the documents' ids and lengths. No document or token is shuffled.

Search. The lists of the items' terms, with the shards' document rows, are brought together by shard, which bounds what a
task holds. There a heap of cursors merges the lists of an item document by document; a bounded heap holds the best (score,
then smaller doc_id). Lists whose greatest contributions together can't lift a document into that heap no longer move the
merge and are only looked up, so no scored document is lost. The shards' best are merged by a ranked window.

Scores are integers: the sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over an item's distinct terms.

Defined results: a null or empty text has no terms and matches nothing; each row of the table is a document, also if its
doc_id is repeated or null (null ids come last among equal scores); rows of one item_id, null included, are one item with the
terms of all; items that no document matches, and empty tables, give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import Scratch
from tessera.llm.words import Words, byte_set, pack, text_blocks, unpack

#: ASCII letters and digits, and every character beyond ASCII.
LETTERS = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
TOP = 10
#: Bytes of text in a shard; what a search task holds is less than its index.
SHARD_BYTES = 1 << 24
#: Terms of items that go to the tasks at a time: one pass over the lists of these terms for each such block of items.
BLOCK_TERMS = 200_000
#: Rows of an Arrow batch.
ROWS = 1 << 16

INDEX = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("postings", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
    ]
)


def shard_rows(ids: pa.Array, texts: pa.LargeStringArray, shard: int) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard."""
    schema = to_arrow_schema(INDEX)
    words = Words(texts, LETTERS)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), null))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    yield pa.RecordBatch.from_pylist(
        [
            {
                "shard": shard,
                "n_docs": int(np.count_nonzero(words.counts)),
                "n_tokens": int(words.counts.sum()),
                "doc_ids": ids.take(pa.array(order)).to_pylist(),
                "lengths": words.counts[order].tolist(),
            }
        ],
        schema,
    )
    if not len(words.codes):
        return
    width = len(order)
    key = words.codes.astype(np.int64) * width + np.repeat(number, words.counts)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(first, len(key)))
    tokens = np.append(np.concatenate(([0], np.cumsum(tf)))[:-1], len(key))
    term, doc = np.divmod(key[first], width)
    begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))  # every code occurs, so list k is of name k
    gap = np.diff(doc, prepend=0)
    gap[begin] = doc[begin]
    stream = np.empty(2 * len(doc), np.int64)
    stream[0::2], stream[1::2] = gap, tf
    data, at = pack(stream)
    bounds = np.append(begin, len(doc))
    offsets = at[2 * bounds]
    for a in range(0, len(begin), ROWS):
        b = min(a + ROWS, len(begin))
        n = b - a
        part = data[offsets[a] : offsets[b]]
        lists = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pa.py_buffer(part)])
        nulls = pa.nulls(n, schema.field("doc_ids").type)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)),
                words.names.slice(a, n).cast(pa.large_string()).cast(pa.string()),
                pa.array(np.diff(bounds[a : b + 1])),
                pa.array(np.diff(tokens[bounds[a : b + 1]])),
                lists,
                nulls,
                nulls,
            ],
            schema=schema,
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index rows of all documents. Save them before searching: a search reads them more than once."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(text_blocks(batches, 1, shard_bytes)):
            yield from shard_rows(block.column(0), block.column(1), (block.column(2)[0].as_py() << 32) + k)

    return rows.mapInArrow(run, INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["item_id"], T.StructField("term", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 1, SHARD_BYTES):
            words = Words(block.column(1), LETTERS)
            of = np.repeat(np.arange(block.num_rows), words.counts)
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(of)), words.names.take(pa.array(words.codes)).cast(pa.large_string()).cast(pa.string())], ["item_id", "term"])

    return rows.mapInArrow(run, schema).distinct()


def weight(n: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * df + 1)))


def _norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these lengths."""
    if 90 * n * int(lengths.max(initial=0)) < 1 << 63:
        return 10 + 90 * n * lengths // max(total, 1)
    return np.array([10 + 90 * n * int(x) // total for x in lengths], np.int64)


def merge(lists: list[tuple[int, list[int], list[int]]], top: int) -> list[tuple[int, int]]:
    """(score, document number) of the `top` best. lists: greatest contribution, document numbers in order, contributions."""
    lists = sorted(lists)
    docs, parts = [x[1] for x in lists], [x[2] for x in lists]
    reach = list(accumulate(x[0] for x in lists))  # what the lists up to one can give together
    at = [0] * len(lists)
    kept: list[tuple[int, int]] = []
    least, first = 0, 0  # lists before `first` are only looked up
    cursors = [(d[0], j) for j, d in enumerate(docs)]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            j = cursors[0][1]
            k = at[j]
            score += parts[j][k]
            at[j] = k = k + 1
            if k < len(docs[j]):
                heapq.heapreplace(cursors, (docs[j][k], j))
            else:
                heapq.heappop(cursors)
        for j in range(first - 1, -1, -1):
            if score + reach[j] <= least:
                break
            own = docs[j]
            at[j] = k = bisect_left(own, doc, at[j])
            if k < len(own) and own[k] == doc:
                score += parts[j][k]
        if score <= least:
            continue
        if len(kept) < top:
            heapq.heappush(kept, (score, -doc))
        else:
            heapq.heapreplace(kept, (score, -doc))
        if len(kept) == top and kept[0][0] > least:
            least, before = kept[0][0], first
            while first < len(reach) and reach[first] <= least:
                first += 1
            if first > before:
                cursors = [c for c in cursors if c[1] >= first]
                heapq.heapify(cursors)
    return [(score, -doc) for score, doc in kept]


def _searcher(shared, schema: pa.Schema, top: int):
    """A function from the rows of one shard to its best documents for each item."""

    def run(rows: pa.Table) -> pa.Table:
        ids, weights, n, total = shared.value
        rows = rows.to_pydict()
        own = rows["term"].index(None)
        doc_ids, m = rows["doc_ids"][own], _norms(np.array(rows["lengths"][own], np.int64), n, total)
        lists = {}
        for term, data in zip(rows["term"], rows["postings"], strict=True):
            if term is not None and (w := weights.get(term)):
                stream = unpack(data)
                doc, tf = np.cumsum(stream[0::2]), stream[1::2]
                part = w * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                lists[term] = (int(part.max()), doc.tolist(), part.tolist())
        best = []
        for item, names in ids.items():
            if have := [lists[t] for t in names if t in lists]:
                best += [(item, doc_ids[doc], score) for score, doc in merge(have, top)]
        columns = list(zip(*best, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def search(index: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    spark = index.sparkSession
    scratch = Scratch(spark)
    terms = scratch.save(item_terms(items, id_col, text_col), "terms")
    wanted = terms.select("term").distinct()
    is_doc = F.col("term").isNull()
    size = index.where(is_doc).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    listed = index.where(~is_doc).select("shard", "term", "n_docs", "postings")
    hits = scratch.save(listed.join(F.broadcast(wanted) if wanted.count() <= block_terms else wanted, "term", "left_semi"), "hits")
    shards = index.where(is_doc).select("shard", "doc_ids", "lengths")
    df = hits.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighed = scratch.save(terms.join(df, "term").select("item_id", "term", weight(size.n, F.col("df")).alias("w")).where("w > 0"), "weighed")
    found = T.StructType([terms.schema["item_id"], T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    blocks = weighed.count() // block_terms + 1
    out = None
    for b in range(blocks):
        mine = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        ids: dict = {}
        weights: dict[str, int] = {}
        for r in mine.toLocalIterator():
            ids.setdefault(r.item_id, []).append(r.term)
            weights[r.term] = r.w
        shared = spark.sparkContext.broadcast((ids, weights, size.n, size.tokens))
        lists = hits.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi") if blocks > 1 else hits
        both = lists.select("shard", "term", "postings", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<long>").alias("lengths")).unionByName(
            shards.select("shard", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("postings"), "doc_ids", "lengths")
        )

        part = both.groupBy("shard").applyInArrow(_searcher(shared, to_arrow_schema(found), top), found)
        out = part if out is None else out.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


OP11_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT doc_id, len(words) AS n FROM d WHERE len(words) > 0),
z AS (SELECT count(*) AS big, sum(n)::BIGINT AS total FROM s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big) // total))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN s USING (doc_id), z GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Scratch(spark).save(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "index")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
