"""File sources and sinks: JSON lines, whole JSON objects, CSV gold sets, trees of files, vectors, bulk lines, datasets and manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path is there, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share. Where the setting is missing, a local session gets a local
    folder, as in tests; any other fails, since its executors would not see one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped, a missing path is empty, a line that is no object fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tree(spark: SparkSession, top: str, pattern: str, schema: T.StructType) -> DataFrame:
    """Objects of all files below `top` whose name matches, with the file's path and its folder's name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(top)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file_path"), F.regexp_replace(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1), "_", " ").alias("root_name"))


def gold_set(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header; values trimmed, null as an empty string; rows without a query go."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = set(rows.columns)
    rows = rows.select(*[(F.trim(F.coalesce(F.col(c), F.lit(""))) if c in have else F.lit("")).alias(c) for c in columns])
    return rows.where(F.col(columns[0]) != "")


def checked_vectors(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Rows with a key and a vector; a vector of another length fails the job."""
    kept = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    checked = F.when(F.size(vector) == dims, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {dims} values: "), F.col(key).cast("string"))).cast(rows.schema[vector].dataType))
    return kept.withColumn(vector, checked)


def bulk_lines(rows: DataFrame, index: str, key: str, columns: list[str]) -> DataFrame:
    """key, part, line: an action line and a source line for each row, as a bulk interface reads them."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    return rows.select(key, F.posexplode(F.array(action, F.to_json(F.struct(*columns)))).alias("part", "line"))


def write_bulk(lines: DataFrame, key: str, path: str) -> None:
    """Bulk lines as text, the two lines of a row side by side within a part file."""
    lines.repartition(F.col(key)).sortWithinPartitions(key, "part").select("line").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_datasets(named: dict[str, DataFrame], top: str, spark: SparkSession) -> DataFrame:
    """Each dataset as Parquet below `top`, and a manifest of their row counts, counted from what was written."""
    counts = None
    for name, rows in named.items():
        rows.write.mode("overwrite").parquet(f"{top}/{name}")
        one = spark.read.parquet(f"{top}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionAll(one)
    write_json(counts.coalesce(1), f"{top}/manifest")
    return spark.read.schema("name string, rows long").json(f"{top}/manifest")


def write_graph(nodes: DataFrame, edges: DataFrame, top: str) -> None:
    """Nodes and edges, a folder for each kind."""
    nodes.write.mode("overwrite").partitionBy("kind").json(f"{top}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").json(f"{top}/edges")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def embedded_rows(spark: SparkSession, glob: str, schema: T.StructType, key: str, vector: str, limit: int | None = None) -> DataFrame:
    """JSON lines of all files that match, at most `limit` of them; lines without a key or a vector are left out."""
    rows = spark.read.schema(schema).json(glob).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows if limit is None else rows.limit(limit)


def write_embeddings(rows: DataFrame, key: str, vector: str, handed_on: Column, top: str, spark: SparkSession) -> DataFrame:
    """Vectors and metadata as datasets of their own, joined by the key; rows of `handed_on` without vectors; and a manifest of
    rows and dimensions, counted from what was written."""
    meta = [c for c in rows.columns if c != vector]
    rows.select(key, vector).write.mode("overwrite").parquet(f"{top}/vectors")
    write_json(rows.select(*meta), f"{top}/meta")
    write_json(rows.where(handed_on).select(*meta), f"{top}/handoff")
    counts = spark.read.parquet(f"{top}/vectors").agg(F.lit("vectors").alias("part"), F.count("*").alias("n"), F.min(F.size(vector)).cast("long").alias("dims"))
    for part in ("meta", "handoff"):
        counts = counts.unionAll(spark.read.schema(rows.select(*meta).schema).json(f"{top}/{part}").agg(F.lit(part), F.count("*"), F.lit(None).cast("long")))
    write_json(counts.coalesce(1), f"{top}/manifest")
    return spark.read.schema("part string, n long, dims long").json(f"{top}/manifest")
