"""Queries of merges with provenance, alias and prefix joins, and edges from relation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.operators import provenance as pv
from tessera.operators import ranking as rk
from tessera.plans.registry import query, table


@query(
    "jn16_merged_references", "JN16",
    """WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS article FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS article FROM lineitem WHERE l_returnflag <> 'N')
    SELECT coalesce(s.l_orderkey, b.l_orderkey) AS law, coalesce(s.article, b.article) AS article, CASE WHEN s.article IS NULL THEN 'body' WHEN b.article IS NULL THEN 'structured' ELSE 'body,structured' END AS provenance
    FROM s FULL JOIN b ON s.l_orderkey = b.l_orderkey AND s.article = b.article""",
)
def merged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of dedicated fields and of the text, each once, with where they stand."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("law"), (F.col("l_partkey") % 50).alias("article"), "l_linestatus", "l_returnflag")
    return pv.merge_sources({"structured": li.where("l_linestatus = 'O'"), "body": li.where("l_returnflag <> 'N'")}, ["law", "article"])


@query(
    "jn21_merged_numbers", "JN21 FN13",
    """WITH k AS (SELECT o_orderkey, (1990 + o_orderkey % 30)::VARCHAR || '다' || (o_custkey % 99 + 1)::VARCHAR AS a, (1990 + o_orderkey % 30)::VARCHAR || '다' || (o_orderkey % 99 + 1)::VARCHAR AS b FROM orders),
    s AS (SELECT o_orderkey, a AS number, 'structured' AS src FROM k UNION ALL SELECT o_orderkey, a, 'body' FROM k WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, b, 'body' FROM k)
    SELECT o_orderkey, number, string_agg(DISTINCT src, ',' ORDER BY src) AS provenance FROM s GROUP BY ALL""",
)
def merged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case numbers of a field and of a text, normalised, with where they stand."""
    from tessera.functions.text import case_numbers

    k = F.col("o_orderkey")
    year = (1990 + k % 30).cast("string")
    a, b = F.concat(year, F.lit(" 다 "), (F.col("o_custkey") % 99 + 1).cast("string")), F.concat(year, F.lit("다"), (k % 99 + 1).cast("string"))
    o = table(spark, sf_dir, "orders")
    numbers = lambda said: o.select("o_orderkey", F.explode(case_numbers(said)).alias("number"))
    body = F.concat(F.lit("참조 "), b, F.when(k % 2 == 0, F.concat(F.lit(", "), a)).otherwise(F.lit(" 판결")))
    return pv.merge_sources({"structured": numbers(a), "body": numbers(body)}, ["o_orderkey", "number"])


@query(
    "jn7_asset_lookup", "JN7",
    """WITH a AS (SELECT p_brand AS brand, count(*) AS n, max(p_retailprice) AS best FROM part WHERE p_size > 40 GROUP BY 1) SELECT p_partkey, coalesce(a.n, 0) AS n, a.best AS best FROM part LEFT JOIN a ON a.brand = p_brand AND p_size <= 10""",
)
def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its asset, where it has one."""
    p = table(spark, sf_dir, "part")
    assets = p.where("p_size > 40").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("best"))
    return p.join(assets, (F.col("p_brand") == F.col("brand")) & (F.col("p_size") <= 10), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), "best")


_NAMES = "n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) FROM part)"


@query("jn11_prefix_both_ways", "JN11", f"WITH {_NAMES} SELECT a.name AS short, b.name AS long FROM n a JOIN n b ON starts_with(b.name, a.name) AND a.name <> b.name WHERE trim(a.name) <> ''")
def prefix_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root names of which one begins the other, whichever side it stands on."""
    words = F.split("p_type", " ")
    p = table(spark, sf_dir, "part").select("p_type", words[0].alias("one"), F.concat_ws(" ", words[0], F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))).alias("two"))
    return pv.prefix_pairs(p.select(F.explode(F.array("p_type", "one", "two")).alias("name")), "name")


@query(
    "jn22_nodes_of_relations", "JN22 AG6",
    """WITH e AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS title, NULL AS kind, o_orderkey * 2 AS place FROM orders UNION ALL SELECT o_orderkey % 100, NULL, o_orderstatus, o_orderkey * 2 + 1 FROM orders)
    SELECT id, arg_min(title, place) FILTER (trim(title) <> '') AS title, arg_min(kind, place) FILTER (trim(kind) <> '') AS kind FROM e GROUP BY id""",
)
def nodes_of_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from both ends of each relation, each column its first filled value."""
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    rel = o.select(F.col("o_custkey").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("at"), none.alias("ak"), (F.col("o_orderkey") % 100).alias("b"), none.alias("bt"), F.col("o_orderstatus").alias("bk"), "o_orderkey")
    ends = pv.both_ends(rel, ["a", "at", "ak", "o_orderkey"], ["b", "bt", "bk", "o_orderkey"], ["id", "title", "kind", "k"])
    return pv.first_filled_by(ends.withColumn("place", F.col("k") * 2 + F.col("end")), "id", ["title", "kind"], "place")


@query(
    "gr5_reference_edges", "GR5 AG5",
    """WITH r AS (SELECT l_orderkey % 60 AS src, l_suppkey AS law, l_partkey % 7 AS article, l_discount AS confidence FROM lineitem), k AS (SELECT s_suppkey AS law, a.x AS article FROM supplier, (SELECT unnest(range(0, 3)) AS x) a WHERE s_suppkey % 3 <> 0),
    m AS (SELECT r.*, k.law IS NOT NULL AS known FROM r LEFT JOIN k ON r.law = k.law AND r.article = k.article WHERE src <> r.law), f AS (SELECT DISTINCT src, law FROM m WHERE known)
    SELECT src, law::VARCHAR || '::' || article::VARCHAR AS dst, 'REFERS_TO_ARTICLE' AS kind, count(*) AS mentions, max(confidence) AS confidence FROM m WHERE known GROUP BY src, law, article
    UNION ALL SELECT src, law::VARCHAR, 'REFERS_TO_LAW', count(*), max(confidence) FROM m WHERE NOT known AND (src, law) NOT IN (SELECT (src, law) FROM f) GROUP BY src, law""",
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to articles that are nodes; an edge to the law only where none of a pair's led to an article."""
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 60).alias("src"), F.col("l_suppkey").alias("law"), (F.col("l_partkey") % 7).alias("article"), F.col("l_discount").alias("confidence"))
    articles = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("law"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("article"))
    return pv.reference_edges(refs, articles)


_MODELS = """r AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'law_to_case' WHEN 1 THEN 'article_to_case' WHEN 2 THEN 'case_to_case' WHEN 3 THEN 'case_to_law' WHEN 4 THEN 'case_to_article' ELSE 'other' END AS model, o_custkey AS source, o_orderkey % 200 AS target FROM orders)"""


@query(
    "gr6_case_edges", "GR6",
    f"""WITH {_MODELS}, ids AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0) SELECT source, target, CASE model WHEN 'law_to_case' THEN 'INTERPRETED_BY' WHEN 'article_to_case' THEN 'APPLIED_IN' WHEN 'case_to_case' THEN 'CITES' WHEN 'case_to_law' THEN 'CONSTRUES' ELSE 'CONSTRUES_ARTICLE' END AS kind, count(*) AS n
    FROM r WHERE model <> 'other' AND source <> target AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) GROUP BY ALL""",
)
def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation rows as edges of five kinds, both ends being nodes."""
    m = F.col("o_orderkey") % 6
    model = F.when(m == 0, "law_to_case").when(m == 1, "article_to_case").when(m == 2, "case_to_case").when(m == 3, "case_to_law").when(m == 4, "case_to_article").otherwise("other")
    rel = table(spark, sf_dir, "orders").select(model.alias("model"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 200).alias("target"))
    return pv.case_edges(rel, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query(
    "ag5_edge_union", "AG5",
    """SELECT l_suppkey AS src, l_partkey % 30 AS dst, max(l_discount) AS confidence, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY 1, 2""",
)
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges met again: their lists united, the greatest confidence kept."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 30).alias("dst"), F.col("l_discount").alias("confidence"), F.array("l_returnflag").alias("flags"), F.array("l_linestatus").alias("statuses"))
    out = pv.upsert_edges(e, ["src", "dst"], ["flags", "statuses"], "confidence")
    return out.select("src", "dst", "confidence", F.array_join("flags", ",").alias("flags"), F.array_join("statuses", ",").alias("statuses"))


@query(
    "wn15_best_match", "WN15",
    """WITH c AS (SELECT c_custkey, n_nationkey, n_name, CASE c_custkey % 3 WHEN 0 THEN 'united states' WHEN 1 THEN 'united' ELSE 'zzz' END AS wanted FROM customer JOIN nation ON n_regionkey = c_custkey % 5),
    t AS (SELECT *, CASE WHEN replace(lower(n_name), ' ', '') = replace(wanted, ' ', '') THEN 0 WHEN contains(replace(lower(n_name), ' ', ''), replace(wanted, ' ', '')) THEN 1 ELSE 2 END AS tier FROM c)
    SELECT c_custkey, n_name, tier FROM t QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY tier, n_nationkey) = 1""",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what a search returns the law of the same name, else one that holds it, else the first."""
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows at any scale
    m = F.col("c_custkey") % 3
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(m == 0, "united states").when(m == 1, "united").otherwise("zzz").alias("wanted"))
    rows = c.join(n, F.col("n_regionkey") == F.col("c_custkey") % 5)
    return pv.best_match(rows, "c_custkey", F.col("n_name"), F.col("wanted"), "n_nationkey").select("c_custkey", "n_name", "tier")


@query(
    "st4_known_names", "ST4 FN34",
    """WITH p AS (SELECT p_partkey, p_brand, split_part(p_type, ' ', 1) AS t FROM part), a AS (SELECT p_partkey, list_distinct(list_filter([CASE WHEN t = 'PROMO' THEN 'SMALL' ELSE t END, 'STANDARD', 'none', CASE WHEN t = 'PROMO' THEN 'SMALL' ELSE t END], lambda x: list_contains(['STANDARD', 'SMALL', 'LARGE'], x))) AS l, t FROM p)
    SELECT p_partkey, CASE WHEN t IN ('PROMO', 'SMALL') THEN 'SMALL,STANDARD' WHEN t = 'LARGE' THEN 'LARGE,STANDARD' ELSE 'STANDARD' END AS names, CASE WHEN t IN ('PROMO', 'SMALL') THEN 'LARGE' WHEN t = 'LARGE' THEN 'SMALL' ELSE 'SMALL,LARGE' END AS others FROM a""",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by alias and dictionary, each once in order, and the dictionary's others."""
    t = F.split("p_type", " ")[0]
    found = pv.known_names(F.array(F.concat(F.lit(" "), t), F.lit("STANDARD"), F.lit("none"), t), {"PROMO": "SMALL"}, ("STANDARD", "SMALL", "LARGE"))
    rest = F.array_except(F.array(F.lit("STANDARD"), F.lit("SMALL"), F.lit("LARGE")), found)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("names"), F.array_join(rest, ",").alias("others"))


@query(
    "st5_allowed_rules", "ST5",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'explicit' WHEN o_orderstatus = 'O' THEN 'family,explicit' ELSE 'explicit,family,scope' END AS rules FROM orders""",
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed rules of each list; all of them where none is left."""
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", F.array(F.lit(" explicit "), F.lit("x"), F.lit("explicit"))).when(s == "O", F.array(F.lit("family"), F.lit("explicit"), F.lit(""))).otherwise(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("odd"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(pv.allowed_or_default(raw, ("explicit", "family", "scope")), ",").alias("rules"))


@query(
    "st6_merged_views", "ST6 GR14",
    """WITH known AS (SELECT 'n' || n_nationkey::VARCHAR AS id, 'r' || n_regionkey::VARCHAR AS src FROM nation WHERE n_nationkey < 15)
    SELECT id, src, 1 AS hop FROM known UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR, 2 FROM nation WHERE n_nationkey >= 15 UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'n' || c_nationkey::VARCHAR, 2 FROM customer""",
)
def merged_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of nodes with the edge they were reached by, and what an expansion adds, one hop further out."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("src"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("src"))
    known = n.where("n_nationkey < 15").select("id", "src", F.lit(1).alias("hop"))
    return gr.merge_views(known, n.select("id", "src").unionAll(c).unionAll(c.where("src = 'n1'")), ["id", "src"], 1)


@query(
    "st8_relation_models", "ST8",
    """WITH r AS (SELECT o_orderkey * 3 AS id, o_orderstatus AS source, 'law_to_law' AS model FROM orders UNION ALL SELECT o_orderkey * 3 + 1, o_orderstatus, 'case_to_case' FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey * 3 + 2, o_orderstatus, 'law_to_case' FROM orders)
    SELECT id, model, row_number() OVER (ORDER BY id) AS place FROM r""",
)
def relation_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of three models in one order of ids; case rows of a barred kind are no sources."""
    o = table(spark, sf_dir, "orders")
    rows = lambda k: o.select((F.col("o_orderkey") * 3 + k).alias("id"), F.col("o_orderstatus").alias("source"))
    every = pv.relation_rows({"law_to_law": rows(0), "case_to_case": rows(1), "law_to_case": rows(2)}, ("P",))
    placed = rk.places(every.select("id", "model", F.lit("all").alias("g"), F.lit(0).alias("k")), "g", "k", "id")
    return placed.select("id", "model", "place")
