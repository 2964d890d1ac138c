"""Product codes of vectors: four codebooks fitted by rounds of integer k-means over columnar blocks.

Vectors become integers, floor(1024 * x), and are saved once as blocks, a matrix (dimensions x rows) each. A round goes over
these blocks as an RDD: a block's distances to the entries of a codebook are summed dimension by dimension, and sums and counts
of the parts of each entry, int64 tensors of codebook size, are added up within a partition and then through a tree of
reductions, so neither the driver nor a task ever holds more than a few codebooks and one block. The codebooks of a round
are a broadcast of 256 vectors' size. Blocks are read from the shared folder in each round, so a lost executor costs a re-read.

All arithmetic is exact: 32-bit integers where the greatest distance fits them, else 64 bits.

Defined results: rows drop out whose vector is null or empty, holds null or non-finite components, or has another length than the
kept row of the smallest vec_id whose length is a positive multiple of four; vec_ids may repeat or be null (null comes last;
equal ids go by their vectors), and each row gets its code; fewer than 256 rows make codebooks of as many entries; components
whose squared distances would not fit 64 bits count as the greatest (least) that do, and a label_error beyond 64 bits is
null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import SALTS, Scratch

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of a block, and those whose distances to all entries are held at once.
BLOCK_ROWS = 8192
STRIPE = 512
#: Labels whose sums may be broadcast; beyond it they are joined by shuffling, dealt out over salts.
BROADCAST_LABELS = 100_000


def scaled(x: np.ndarray, dims: int) -> np.ndarray:
    """floor(1024 * x) as int64, kept within what squared distances of `dims` components can hold."""
    most = math.isqrt((1 << 62) // max(dims, 1)) // 2
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """block: (parts, width, rows), books: (parts, entries, width). Index of the nearest entry, ties to the lower, and the
    squared distance: (parts, rows) each."""
    parts, width, rows = block.shape
    codes, best = np.empty((parts, rows), np.int64), np.empty((parts, rows), np.int64)
    reach = int(np.abs(block).max(initial=0)) + int(np.abs(books).max(initial=0))
    kind = np.int32 if width * reach * reach < 1 << 31 else np.int64
    for p in range(parts):
        x, book = block[p].astype(kind), books[p].astype(kind)
        for a in range(0, rows, STRIPE):
            n = min(STRIPE, rows - a)
            total, step = np.zeros((n, len(book)), kind), np.empty((n, len(book)), kind)
            for d in range(width):
                np.subtract(x[d, a : a + n, None], book[None, :, d], out=step)
                np.multiply(step, step, out=step)
                np.add(total, step, out=total)
            codes[p, a : a + n] = c = total.argmin(axis=1)
            best[p, a : a + n] = total[np.arange(n), c]
    return codes, best


def _unblock(values: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(values, np.int64).reshape(PARTS, -1, rows)


def to_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """vec_ids, labels, values: blocks of up to BLOCK_ROWS rows, values as (parts, width, rows) int64."""
    schema = T.StructType([T.StructField("vec_ids", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("values", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), dims)
                lists = [pa.array([c.to_pylist()], f.type) for c, f in zip((part.column(0), part.column(2)), arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], schema=arrow)

    return rows.select("vec_id", "vector", "label").mapInArrow(run, schema)


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after `rounds` assignments and replacements; an entry without parts stays."""
    sc = blocks.sparkSession.sparkContext
    rdd = blocks.select("vec_ids", "values").rdd
    depth = 2 if rdd.getNumPartitions() <= 10_000 else 3
    for _ in range(rounds):
        shared = sc.broadcast(books)

        def add(acc, row, shared=shared):
            books = shared.value
            sums, counts = acc or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
            block = _unblock(row["values"], len(row["vec_ids"]))
            codes, _ = nearest(block, books)
            for p in range(PARTS):
                np.add.at(sums[p], codes[p], block[p].T)
                np.add.at(counts[p], codes[p], 1)
            return sums, counts

        def both(a, b):
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        sums, counts = rdd.treeAggregate(None, add, both, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    lead = rows.where(F.size("vector") % PARTS == 0).orderBy(*first).select(F.size("vector").alias("dims")).first()
    dims = lead.dims if lead else PARTS
    rows = rows.where(F.size("vector") == dims)
    seeds = np.array([r.vector for r in rows.orderBy(*first).limit(entries).select("vector").collect()]).reshape(-1, dims)
    books = np.ascontiguousarray(scaled(seeds, dims).reshape(len(seeds), PARTS, dims // PARTS).swapaxes(0, 1))
    blocks = scratch.save(to_blocks(rows, dims), "blocks")
    if len(seeds):
        books = fit(blocks, books, rounds)
    shared = spark.sparkContext.broadcast(books)
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for ids, labels, values in zip(*batch.columns, strict=True):
                codes, error = nearest(_unblock(values.as_buffer(), len(ids)), shared.value)
                names = [bytes(c).hex() for c in codes.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(names, pa.string()), pa.array(error.sum(axis=0))], schema=arrow)

    coded = scratch.save(blocks.mapInArrow(run, schema), "coded")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return _with_sums(coded, scratch).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _with_sums(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """label_error: the errors of the row's label together, null being a label. Sums are combined before the shuffle."""
    sums = scratch.save(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "sums")

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same(F.col("label"), F.col("_label")), "left")
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS))
    return coded.withColumn("_of", salt.cast("int")).join(sums, same(F.col("label"), F.col("_label")) & (F.col("_of") == F.col("_salt")), "left")


def _sql(rounds: int = ROUNDS) -> str:
    near = "SELECT vec_id, part, min(d * 256 + entry) AS best FROM (SELECT vec_id, part, entry, sum((x - y) * (x - y)) AS d FROM x JOIN c{0} USING (part, pos) GROUP BY ALL) GROUP BY ALL"
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, part, pos, e[part * (len(e) // 4) + pos + 1] AS x FROM (SELECT vec_id, e, unnest(range(4)) AS part FROM v) t, unnest(range(len(e) // 4)) u(pos))",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, x AS y FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id) WHERE entry < 256)",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(k)})",
            f"s{k} AS (SELECT part, best % 256 AS entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL)",
            f"c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n > 0 THEN (s - ((s % n) + n) % n) // n ELSE y END AS y FROM c{k} LEFT JOIN s{k} USING (part, entry, pos))",
        ]
    steps += [
        f"a AS ({near.format(rounds)})",
        "r AS (SELECT vec_id, string_agg(format('{:02x}', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"


OP12_SQL = _sql()


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
