"""Graph queries: regions, nations and customers as a hierarchy; orders link customers and suppliers' nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.plans.registry import query, table

_NODES = "nodes AS (SELECT 'r' || r_regionkey::VARCHAR AS id, 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'customer', c_name FROM customer)"
_EDGES = "edges AS (SELECT 'r' || n_regionkey::VARCHAR AS src, 'n' || n_nationkey::VARCHAR AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey::VARCHAR, 'c' || c_custkey::VARCHAR FROM customer)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), F.lit("nation"), "n_name")
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey"), F.lit("customer"), "c_name")
    return r.unionAll(n).unionAll(c)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    return n.unionAll(table(spark, sf_dir, "customer").select(key("n", "c_nationkey"), key("c", "c_custkey"))).withColumn("kind", F.lit("HAS_CHILD"))


@query("gr1_nodes", "GR1 PJ12", f"WITH {_NODES}, {_EDGES} SELECT n.id, n.kind, n.name, count(e.dst) AS children FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY ALL")
def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("children"))
    return nodes(spark, sf_dir).join(degree, "id", "left").select("id", "kind", "name", F.coalesce("children", F.lit(0)).alias("children"))


@query(
    "gr2_families", "GR2 GR3",
    """WITH f AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part), root AS (SELECT p_brand, p_partkey AS root FROM f WHERE r = 1),
    b AS (SELECT p_brand, p_size, min(p_partkey) AS only_one FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL HAVING count(*) = 1)
    SELECT f.p_partkey, coalesce(b.only_one, root.root) AS parent FROM f JOIN root USING (p_brand) LEFT JOIN b ON b.p_brand = f.p_brand AND b.p_size = f.p_size WHERE f.p_partkey % 2 = 1""",
)
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's parent is the decree of its branch if there is exactly one, else the family's root."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    root = p.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("root"))
    return gr.parents(p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0"), root, "p_partkey", ["p_brand", "p_size"], "p_brand").select("p_partkey", "parent")


@query(
    "gr4_text_edges", "GR4 JN10",
    """WITH k AS (SELECT DISTINCT lower(split_part(p_type, ' ', 2)) AS word, min(p_partkey) AS target FROM part GROUP BY 1), e AS (SELECT p.p_partkey % 40 AS src, k.target AS dst FROM part p JOIN k ON lower(split_part(p.p_type, ' ', 2)) = k.word)
    SELECT src, dst, count(*) AS n, 0.9 AS confidence FROM e WHERE src <> dst AND dst IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""".replace("0.9 AS", "0.9::DOUBLE AS"),
)
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lower(F.split_part("p_type", F.lit(" "), F.lit(2)))
    p = table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))
    targets = p.groupBy("word").agg(F.min("p_partkey").alias("dst"))
    e = p.join(targets, "word").select((F.col("p_partkey") % 40).alias("src"), "dst")
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return gr.merge_edges(gr.with_endpoint(e, known, "dst"), F.lit(0.9))


_HIERARCHY = f"WITH RECURSIVE {_EDGES}, walk(root, id, depth) AS (SELECT src, dst, 1 FROM edges WHERE src LIKE 'r%' UNION ALL SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 5) SELECT root, id, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL"


@query("gr7_bfs", "GR7", _HIERARCHY)
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return gr.descendants(edges(spark, sf_dir), roots, 5).select("root", "id", F.col("depth").cast("long").alias("depth"))


@query("gr8_one_hop", "GR8 GR9 GR10", f"WITH {_NODES}, {_EDGES} SELECT e.src, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src IN ('r1', 'n3')")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.neighbours(edges(spark, sf_dir).where(F.col("src").isin("r1", "n3")), nodes(spark, sf_dir)).select("src", "id", "name")


@query("gr8_one_hop_all", "GR8 GR9 GR10", f"WITH {_NODES}, {_EDGES} SELECT e.src, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.dst")
def one_hop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges; gr8_one_hop expands two nodes."""
    return gr.neighbours(edges(spark, sf_dir), nodes(spark, sf_dir)).select("src", "id", "name")


@query(
    "jn12_three_hop", "JN12",
    """WITH l AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT a.o_custkey AS source, b.o_custkey AS target, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.o_custkey < b.o_custkey GROUP BY ALL HAVING count(*) >= 3""",
)
def three_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers that share three parts or more."""
    return three_hop_all(spark, sf_dir).where("shared >= 3")


@query(
    "jn12_three_hop_all", "JN12",
    """WITH l AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT a.o_custkey AS source, b.o_custkey AS target, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.o_custkey < b.o_custkey GROUP BY ALL""",
)
def three_hop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers over real part keys, every pair that shares a part."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return gr.shared_neighbours(o.join(li, "o_orderkey"), "o_custkey", "l_partkey")


@query(
    "jn12_three_hop_from", "JN12",
    """WITH l AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT a.o_custkey AS source, b.o_custkey AS target, count(*) AS shared FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.o_custkey <> b.o_custkey WHERE a.o_custkey % 100 = 0 GROUP BY ALL""",
)
def three_hop_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customers whose key is divisible by 100 to all who share a part with them."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    links = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    return gr.shared_from(links, "o_custkey", "l_partkey", o.select("o_custkey").where("o_custkey % 100 = 0"))


@query(
    "gr13_expand", "GR13 JN13",
    """SELECT n_name, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT c_name AS x FROM customer WHERE c_nationkey = n_nationkey ORDER BY x LIMIT 50)) AS customers,
       (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT s_name AS x FROM supplier WHERE s_nationkey = n_nationkey ORDER BY x LIMIT 50)) AS suppliers FROM nation""",
)
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of neighbours, each collected on its own and cut at 50 names, so that they never multiply."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = gr.named_neighbours(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", "customers", 50)
    s = gr.named_neighbours(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name", "suppliers", 50)
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", "customers", "suppliers")


@query("sk5_no_dangling", "SK5 JN10", "SELECT count(*) AS n, min(o_orderkey) AS first_order FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def no_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return gr.with_endpoint(table(spark, sf_dir, "orders"), ends, "o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query(
    "wn8_lag_lead", "WN8 GR15",
    """SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next, (row_number() OVER w - 1) // 3 AS batch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    batch = F.floor((F.row_number().over(w) - 1) / 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("previous"), F.lead("role").over(w).alias("next"), batch.cast("long").alias("batch"))
