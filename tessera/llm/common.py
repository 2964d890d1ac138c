"""Written tables that cut lineage, and connected components, for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of ids (rows times columns) that may be broadcast to keep wide rows out of a shuffle; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Keys that the members of one component are dealt out over.
SALTS = 16


class Scratch:
    """Parquet tables in a folder of their own below spark.checkpoint.dir, which all executors share.

    Saving a frame ends its lineage: a lost executor costs a re-read, not a recomputation. If the
    setting is unset, as in tests, a local folder serves and is set.
    """

    def __init__(self, spark: SparkSession):
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            top = tempfile.mkdtemp(prefix="checkpoints-")
            spark.conf.set("spark.checkpoint.dir", top)
        self.spark, self.top, self._paths = spark, f"{top.rstrip('/')}/{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The frame, written and read again; `by`: a column whose values get a folder each."""
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self._paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bytes(self, data: bytes, name: str) -> str:
        """A plain file in the folder; returns its path."""
        path = f"{self.top}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return path

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """All tables saved under the name, together."""
        return self.spark.read.schema(schema).parquet(*self._paths[name])

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; nothing may read them any more."""
        jvm = self.spark._jvm
        for name in names:
            for path in self._paths.pop(name, []):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop_but_last(self, name: str) -> None:
        paths = self._paths.get(name, [])
        if len(paths) > 1:
            self._paths["_old"] = paths[:-1]
            self._paths[name] = paths[-1:]
            self.drop("_old")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for every node of the undirected edges (a, b); component is the least id.

    Every round a node takes the least label among its own and its neighbours' (a minimum, combined
    before the shuffle, so a hub with many edges costs a row a task), then its label's label. Rounds
    go on until nothing changes; labels are written each round, never collected.
    """
    both = scratch.save(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), name)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step = scratch.save(step, f"{name}-step")
        # the labels in use are few against the nodes; a giant component's is dealt out over SALTS keys
        used = step.select("component").distinct()
        jump = step.join(used.withColumnRenamed("component", "id"), "id").select(F.col("id").alias("component"), F.col("component").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        new = scratch.save(salted.join(jump, ["component", "salt"]).select("id", "old", F.col("further").alias("component")), name)
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("id", "component")
        scratch.drop(f"{name}-step")
        scratch.drop_but_last(name)
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def only_ids(rows: DataFrame, ids: DataFrame, *columns: str, how: str = "left_semi") -> DataFrame:
    """Rows whose `columns` are (left_anti: are not) among the distinct ids, a saved table of the same columns:
    by broadcast if they are few enough, which spares shuffling wide rows, else by a shuffled join."""
    few = ids.count() * len(columns) <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, list(columns), how)
