"""Searches over stored indexes: built from the tables once, then read by cell or by term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectorindex as vi
from tessera.operators.postings import Postings
from tessera.plans.registry import query
from tessera.plans.search import _BM25, chunks, query_terms, vectors
from tessera.sources.files import scratch_path


def vector_index(spark: SparkSession, sf_dir: str) -> vi.VectorIndex:
    rows = vectors(spark, sf_dir)
    return vi.VectorIndex.build(rows, scratch_path(spark, "vector-index"), vi.train(rows))


#: Share of the cells that a query may read. The tables' vectors have no neighbourhoods (their directions are spread evenly), so the
#: nearest ones lie in most cells; vectors that do have them need less than a tenth.
SHARE = 0.9


@query("vs1_index_topk", "VS1 SC14")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest of every vector whose id is divisible by 100: codes of the cells near it, and 300 vectors for the exact ranking."""
    queries = vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("source_id").alias("query_id"), "vector")
    out = vector_index(spark, sf_dir).search(queries, 30, SHARE)
    return out.select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"), "cells_read")


@query("vs4_postings_topk", "VS4 SC15", f"WITH {_BM25} SELECT query_id, source_id, rank, round(score, 4) AS score FROM keyword_hits")
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as by scoring every document, from the blocks that can reach them."""
    index = Postings.build(chunks(spark, sf_dir), scratch_path(spark, "postings"), range_docs=64)
    hits, _ = index.search(query_terms(spark), 30)
    return hits.select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))
