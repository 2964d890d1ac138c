"""Graphs as edge and node frames: resolution, merging, neighbours and bounded traversal."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import dealt


def with_endpoint(edges: DataFrame, nodes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Edges whose end is a known node."""
    return edges.join(nodes.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def merge_edges(edges: DataFrame, confidence: Column, src: str = "src", dst: str = "dst") -> DataFrame:
    """One edge a pair, with the number of its mentions and the greatest confidence; loops go."""
    return edges.where(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.count("*").alias("n"), F.max(confidence).alias("confidence"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the node they lead to."""
    return edges.join(nodes, edges.dst == nodes.id).select("src", "id", nodes.kind.alias("kind"), "name")


def named_neighbours(rows: DataFrame, key: str, name: str, alias: str, most: int) -> DataFrame:
    """Each key's distinct neighbour names, the first `most` in order, as one string. The limit is taken before names are listed, so
    a key with many neighbours sends on its first ones only."""
    order = Window.partitionBy(key).orderBy(name)
    first = rows.where(F.col(name).isNotNull()).select(key, name).distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias(alias))


@contextmanager
def _passing(spark: SparkSession) -> Iterator[None]:
    """What is run and planned inside leaves no shuffle files behind; for counts whose plans nothing reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Types of differences to a list's node, narrowest first.
NEAR = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31}


def _narrowed(node: str, listed: str, kind: str) -> dict[str, Column]:
    """A sorted list of greater nodes by columns of which one is not null: differences to the node in the narrowest type that holds them
    all, for whole numbers, or the list as it is."""
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return {"_far": F.col(listed)}
    gap = F.coalesce(F.try_subtract(F.element_at(listed, -1).cast("long"), F.col(node).cast("long")), F.lit((1 << 63) - 1))
    differences = lambda near: F.transform(listed, lambda x: (x.cast("long") - F.col(node).cast("long")).cast(near))
    out, least = {}, 0
    for near, most in NEAR.items():
        out[f"_{near}"] = F.when((gap >= least) & (gap < most), differences(near))
        least = most
    return out | {"_far": F.when(gap >= least, F.col(listed))}


def _widened(node: str, columns: list[str], kind: str) -> Column:
    """The lists that `_narrowed` made columns of."""
    return F.coalesce(*[F.col(c) if c == "_far" else F.transform(c, lambda x: (F.col(node).cast("long") + x.cast("long")).cast(kind)) for c in columns])


def shared_neighbours(links: DataFrame, node: str, middle: str) -> DataFrame:
    """source, target, shared: every pair of nodes (source < target) that link to a common middle node, with the number of those.

    All pairs of a middle node are sent to the tasks that count them as one list for each source, of the targets' differences to it
    where nodes are whole numbers; a task takes the lists of its sources apart. So the disk that pairs take is two to four bytes for
    most, not a row."""
    spark = links.sparkSession
    links = links.select(F.col(node).alias("_n"), F.col(middle).alias("_m")).where("_n IS NOT NULL AND _m IS NOT NULL")
    kind = links.schema["_n"].dataType.simpleString()
    with _passing(spark):
        rows = links.select("_m").count()
        degrees = dealt(links, rows, "_m").distinct().groupBy("_m").agg(F.count("*").alias("n"))
        n = degrees.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0))).first()[0]
    groups = dealt(links, rows, "_m").distinct().groupBy("_m").agg(F.sort_array(F.collect_list("_n")).alias("_ns"))
    after = groups.select(F.posexplode("_ns").alias("_i", "source"), "_ns").where(F.col("_i") + 1 < F.size("_ns"))
    lists = after.select("source", F.slice("_ns", F.col("_i") + 2, F.size("_ns")).alias("_targets"))
    narrow = _narrowed("source", "_targets", kind)
    sent = dealt(lists.select("source", *[c.alias(k) for k, c in narrow.items()]), n, "source")
    pairs = sent.select("source", F.explode(_widened("source", list(narrow), kind)).alias("target"))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("shared"))


#: Nodes around one middle node from which on they are dealt out over several tasks.
HUB = 4096
#: Start nodes and middle nodes that are broadcast.
SENT = 200_000


def shared_from(links: DataFrame, node: str, middle: str, starts: DataFrame, hub: int = HUB) -> DataFrame:
    """source, target, shared: for the given start nodes (one column, `node`) every other node that links to a common middle node, with
    the number of those.

    Only the neighbourhoods of the start nodes are joined: the start nodes select the middle nodes, and these the links of the other
    side. A middle node with more than `hub` links is heavy: its links are dealt out by their node over as many keys as it has hubs
    of them, and its start nodes go to each; all others meet under one key."""
    once = links.select(F.col(node).alias("_n"), F.col(middle).alias("_m")).distinct()
    starts = starts.select(F.col(node).alias("_n")).distinct()
    small = lambda df: F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df
    near = once.join(small(starts), "_n", "left_semi").cache()
    touched = near.select("_m").distinct()
    around = once.join(small(touched), "_m", "left_semi")
    heavy = small(around.groupBy("_m").agg(F.ceil(F.count("*") / hub).cast("int").alias("_parts")).where("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    left = near.join(heavy, "_m", "left").select(F.col("_n").alias("source"), "_m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    right = around.join(heavy, "_m", "left").select(F.col("_n").alias("target"), "_m", F.pmod(F.xxhash64("_n"), parts).cast("int").alias("_part"))
    return left.join(right, ["_m", "_part"]).where("source <> target").groupBy("source", "target").agg(F.count("*").alias("shared"))


def parents(children: DataFrame, middle: DataFrame, roots: DataFrame, key: str, branch: list[str], family: str) -> DataFrame:
    """Each child's parent: the one middle node of its branch if there is exactly one, else its family's root."""
    one = middle.groupBy(*branch).agg(F.count("*").alias("_n"), F.min(key).alias("_one")).where("_n = 1").drop("_n")
    return children.join(one, branch, "left").join(roots, family).withColumn("parent", F.coalesce("_one", "root"))


def descendants(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, id, depth: what can be reached from each root in at most `depth` steps, each node at its least depth. A node already
    reached from a root is not walked again, so cycles end. depth is a small constant of the query."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    frontier = roots.select("root", F.col("root").alias("id"))
    reached = None
    for d in range(1, depth + 1):
        found = frontier.join(step, "id").select("root", F.col("next").alias("id")).distinct()
        if reached is not None:
            found = found.join(reached.select("root", "id"), ["root", "id"], "left_anti")
        found = found.withColumn("depth", F.lit(d))
        reached = found if reached is None else reached.unionAll(found)
        frontier = found.select("root", "id")
    return reached.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def merge_views(known: DataFrame, more: DataFrame, key: list[str], hop: int) -> DataFrame:
    """Rows of a view, and those of an expansion that are not yet in it, one hop further out."""
    return known.unionByName(more.join(known.select(*key), key, "left_anti").dropDuplicates(key).withColumn("hop", F.lit(hop + 1)), allowMissingColumns=True)
