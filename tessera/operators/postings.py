"""A stored inverted index whose posting blocks carry their greatest impact, and keyword search that reads only the blocks it needs.

Building. Each task sorts the documents it reads by length and cuts them into ranges of `range_docs`; a block holds the postings of one term
in one range (how often a document has the term, and its place in the range: the upper and lower 32 bits), and `top`, the greatest value any of them can give (its BM25
part without idf). Ids and lengths stand once for each range. Texts are read twice, for the average length and for the blocks; only finished
blocks are shuffled, those of one range and bucket in a row. They lie by buckets of terms, sorted by term within a file.

Searching. All terms' blocks of one range bound what a document of that range can score. For each query the ranges of greatest bound
are scored first, which gives a score the result must reach; of the others only ranges whose bound reaches it are scored. So each
query skips most blocks and loses no document (ties included).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import K1, TASK_ROWS, B, dealt, few, tokens

RANGE_DOCS = 1024
BUCKETS = 64
#: Ranges of each query that are scored first.
FIRST = 4
#: Bounds are sums of the same products in another order; this much may be lost to rounding.
SLACK = 1e-9
#: Instead of a bucket, for the rows that hold a range's documents.
OWNERS = -1


def _part(tf, dl, avgdl: float, k1: float, b: float):
    """A term's BM25 part without idf, for columns and arrays alike."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _blocks(range_docs: int, buckets: int, k1: float, b: float, avgdl: float):
    """A task's documents (source_id, w) in ranges of `range_docs`: for each a row with its documents and their lengths, and one for each
    bucket of its terms: the terms (blanks between them), and for each its `top` and where its postings start."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, range_docs - n)
                batch, n = batch.slice(piece.num_rows), n + piece.num_rows
                held.append(piece)
                if n == range_docs:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, held in enumerate(ranges(batches)):
            ids, words = held["source_id"].combine_chunks(), held["w"].combine_chunks()
            n, dl = len(ids), pc.list_value_length(words).to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            terms = np.array(coded.dictionary.to_pylist(), object)
            bucket = (pd.util.hash_array(terms, categorize=False) % buckets).astype(np.int32)
            order = np.lexsort((terms, bucket))
            terms, bucket, place = terms[order], bucket[order], np.argsort(order)
            key, tf = np.unique(place[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), dl), return_counts=True)
            doc, starts = key % n, np.flatnonzero(np.diff(key // n, prepend=-1))
            top = np.maximum.reduceat(_part(tf, dl[doc], avgdl, k1, b), starts) if len(starts) else np.zeros(0)
            top = np.nextafter(top.astype(np.float32), np.float32(np.inf))  # never below the value itself
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))  # a bucket's first term; the last row is the range's own
            m, cuts = len(cuts), np.append(cuts, [len(terms)] * 2)
            first_of = np.append(starts, len(key))[cuts]
            spans, own = pa.array(cuts, pa.int32()), pa.array(np.append(np.zeros(m + 1, int), n), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(bucket[cuts[:m]], OWNERS), pa.int32()), pa.array(np.full(m + 1, first + k)), pa.array([" ".join(terms[x:y]) for x, y in zip(cuts[:m], cuts[1:])] + [None], pa.string()),
                pa.ListArray.from_arrays(spans, pa.array(top)), pa.ListArray.from_arrays(spans, pa.array(starts - np.repeat(first_of[:m], np.diff(cuts[: m + 1])), pa.int32())),
                pa.ListArray.from_arrays(pa.array(first_of, pa.int32()), pa.array(doc | tf << 32)), pa.ListArray.from_arrays(own, ids), pa.ListArray.from_arrays(own, pa.array(dl, pa.int32())),
            ], ["bucket", "range", "terms", "tops", "starts", "postings", "ids", "lengths"])

    return build


@dataclass(frozen=True)
class Postings:
    spark: SparkSession
    path: str
    k1: float = K1
    b: float = B

    @classmethod
    def build(cls, corpus: DataFrame, path: str, id_col: str = "source_id", text: str = "text", range_docs: int = RANGE_DOCS, buckets: int = BUCKETS, k1: float = K1, b: float = B) -> Postings:
        spark = corpus.sparkSession
        docs = corpus.select(F.col(id_col).alias("source_id"), F.coalesce(text, F.lit("")).alias("text"))
        dl = F.size(tokens(F.col("text")))
        docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(dl), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum(dl), F.lit(0)).alias("words")).write.parquet(f"{path}/size")
        size = spark.read.parquet(f"{path}/size").first()
        # documents stay in the task that reads them; ranges are cut from its documents of like length
        sized = docs.sortWithinPartitions(F.length("text"), "source_id", "text").select("source_id", tokens(F.col("text")).alias("w"))
        kind = docs.schema["source_id"].dataType.simpleString()
        schema = f"bucket int, range long, terms string, tops array<float>, starts array<int>, postings array<long>, ids array<{kind}>, lengths array<int>"
        made = sized.mapInArrow(_blocks(range_docs, buckets, k1, b, size.avgdl), schema)
        hashed = F.xxhash64("range")
        subs = -(-8 * size.words // (TASK_ROWS * buckets)) or 1  # a large index has about eight keys for each task, so that they get like shares
        sent = dealt(made, size.words, F.when(F.col("bucket") == OWNERS, F.pmod(hashed, F.lit(buckets))).otherwise(F.col("bucket")), F.pmod(hashed, F.lit(subs)))
        each = sent.select("*", F.posexplode_outer(F.split("terms", " ")).alias("_k", "term"))
        start, end = F.get("starts", F.col("_k")), F.coalesce(F.get("starts", F.col("_k") + 1), F.size("postings"))
        rows = each.select("bucket", "term", "range", (end - start).cast("long").alias("n"), F.get("tops", F.col("_k")).alias("top"), F.slice("postings", start + 1, end - start).alias("postings"), "ids", "lengths")
        rows.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/blocks")
        return cls(spark, path, k1, b)

    def blocks(self, terms: DataFrame) -> DataFrame:
        """Blocks of the distinct terms; only their buckets are read."""
        named = self.spark.read.parquet(f"{self.path}/blocks").where(F.col("bucket") != OWNERS)
        return named.join(F.broadcast(terms) if few(terms) else terms, "term", "left_semi")

    def search(self, terms: DataFrame, top: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """(query_id, source_id, score, rank) by BM25 over an OR of the query's terms (query_id, term); and for each query how many
        blocks its terms have and how many were scored (query_id, n_blocks, n_read)."""
        wanted = terms.select("query_id", "term").distinct()
        size = self.spark.read.parquet(f"{self.path}/size").first()
        heads = self.blocks(wanted.select("term").distinct()).select("term", "range", "n", "top").cache()
        idf = heads.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.log(1 + (size.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        asked = wanted.join(idf, "term").cache()
        sent = F.broadcast(asked) if few(asked) else asked
        bounds = heads.join(sent, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.count("*").alias("n_blocks"))
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        bounds = bounds.withColumn("place", F.row_number().over(best)).cache()
        lead = self._scored(asked, bounds.where(F.col("place") <= first)).cache()
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id")
        reached = lead.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == top).select("query_id", F.col("score").alias("least"))
        rest = bounds.where(F.col("place") > first).join(F.broadcast(reached) if few(reached) else reached, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("least")))
        rest = rest.select("query_id", "range", "n_blocks").cache()
        scored = lead.unionByName(self._scored(asked, rest))
        hits = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        read = bounds.where(F.col("place") <= first).select("query_id", "n_blocks").unionByName(rest.select("query_id", "n_blocks")).groupBy("query_id").agg(F.sum("n_blocks").alias("n_read"))
        report = bounds.groupBy("query_id").agg(F.sum("n_blocks").alias("n_blocks")).join(read, "query_id")
        return hits, report

    def _scored(self, asked: DataFrame, ranges: DataFrame) -> DataFrame:
        """query_id, source_id, score of all documents in the query's ranges."""
        spots = asked.join(ranges.select("query_id", "range"), "query_id")
        stored = self.spark.read.parquet(f"{self.path}/blocks")
        blocks = stored.where(F.col("bucket") != OWNERS).select("term", "range", "postings")
        owners = stored.where(F.col("bucket") == OWNERS).select("range", "ids", "lengths")
        met = blocks.join(F.broadcast(spots) if few(spots, 100_000) else spots, ["term", "range"]).join(owners, "range")
        met = met.select("query_id", "idf", "ids", "lengths", F.explode("postings").alias("p"))
        size = self.spark.read.parquet(f"{self.path}/size").first()
        doc = F.col("p").bitwiseAND(0xFFFFFFFF).cast("int")
        part = _part(F.shiftright("p", 32), F.get("lengths", doc), size.avgdl, self.k1, self.b)
        met = met.select("query_id", "idf", F.get("ids", doc).alias("source_id"), part.alias("part"))
        return met.groupBy("query_id", "source_id").agg(F.round(F.sum(F.col("idf") * F.col("part")), 9).alias("score"))
