"""Queries of joins, merges and aggregations, on the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import merging as mg
from tessera.operators.containment import containing
from tessera.operators.retrieval import small
from tessera.plans.registry import query, table


@query(
    "ag1_merge_canonical", "AG1 AG18 WN6",
    """SELECT l_orderkey AS case_id, count(*) AS n, sum(l_linenumber)::BIGINT AS hits, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, arg_min(l_partkey, struct_pack(a := CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, b := l_linenumber, c := l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey""",
)
def merge_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("l_linenumber").cast("long")).alias("hits"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"),
        mg.first_by("l_partkey", F.when(F.col("l_linestatus") == "F", 0).otherwise(1), F.col("l_linenumber"), F.col("l_partkey")).alias("first_part"),
    )


@query(
    "ag2_merge_rows", "AG2 ST2",
    """WITH o AS (SELECT l_orderkey, kind, min(struct_pack(a := l_linenumber, b := kind)) AS p FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS kind FROM lineitem) GROUP BY ALL),
    m AS (SELECT l_orderkey, string_agg(kind, ',' ORDER BY p) AS kinds FROM o GROUP BY 1)
    SELECT l.l_orderkey, sum(l_linenumber)::BIGINT AS n, max(l_discount) AS confidence, bool_or(l_returnflag = 'R') AS verified, min(m.kinds) AS kinds FROM lineitem l JOIN m USING (l_orderkey) GROUP BY l.l_orderkey""",
)
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return rows.groupBy("l_orderkey").agg(
        F.sum(F.col("l_linenumber").cast("long")).alias("n"), F.max("l_discount").alias("confidence"), F.bool_or(F.col("l_returnflag") == "R").alias("verified"),
        F.array_join(mg.distinct_in_order("kind", "l_linenumber"), ",").alias("kinds"),
    )


@query(
    "ag3_merge_references", "AG3 AG4",
    """SELECT o_custkey % 100 AS source, o_custkey % 7 AS target, count(*) AS n, max(o_totalprice) AS confidence,
       arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS status, arg_max(o_orderpriority, struct_pack(a := length(o_orderpriority), b := -o_orderkey)) AS longest
       FROM orders WHERE o_custkey % 100 <> o_custkey % 7 GROUP BY ALL""",
)
def merge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("source"), (F.col("o_custkey") % 7).alias("target"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return rows.where("source <> target").groupBy("source", "target").agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("confidence"), mg.by_priority("o_orderstatus", ("F", "O", "P")).alias("status"),
        F.max_by("o_orderpriority", F.struct(F.length("o_orderpriority"), -F.col("o_orderkey"))).alias("longest"),
    )


@query(
    "ag6_coalesce_nodes", "AG7",
    """SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS first_priority, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS largest FROM orders GROUP BY o_custkey""",
)
def coalesce_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    filled = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return o.groupBy("o_custkey").agg(F.min_by("o_orderpriority", filled).alias("first_priority"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"))


@query(
    "ag8_scan_profile", "AG8 AG11 WF7",
    """SELECT source, count(*) AS n, count(*) FILTER (trim(text) <> '') AS filled, count(*) FILTER (lang = 'en') AS en, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source""",
)
def scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("filled"), F.count_if(F.col("lang") == "en").alias("en"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars")
    )


@query("ag9_duplicates", "AG9", "SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    "ag10_cost_rollup", "AG10",
    """SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, sum(ceil(n_chars / 2.5)::BIGINT)::BIGINT AS tokens, round(sum(ceil(n_chars / 2.5)::BIGINT)::DOUBLE * 0.00013 / 1000, 6) AS cost FROM documents GROUP BY ROLLUP (lang, source)""",
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(F.ceil(F.col("n_chars") / 2.5).cast("long"))
    out = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), tokens.alias("tokens"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "tokens", F.round(F.col("tokens").cast("double") * 0.00013 / 1000, 6).alias("cost"))


def _levels(events: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("view", "none"), ("click", "low"), ("signup", "mid"), ("purchase", "high")) for x in p])
    e = events.select((F.col("user_id") % 10).alias("bucket"), F.coalesce(F.try_element_at(names, "event_type"), F.lit("crit")).alias("level"))
    return mg.level_counts(e, "bucket", "level", ("none", "low", "mid", "high", "crit"))


_LEVELS = """WITH lv(level, no) AS (VALUES ('none', 0), ('low', 1), ('mid', 2), ('high', 3), ('crit', 4)), e AS (SELECT user_id % 10 AS bucket, CASE event_type WHEN 'view' THEN 'none' WHEN 'click' THEN 'low' WHEN 'signup' THEN 'mid' WHEN 'purchase' THEN 'high' ELSE 'crit' END AS level FROM events),
    c AS (SELECT bucket, level, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT bucket, arg_max(level, no) AS worst FROM c JOIN lv USING (level) GROUP BY bucket)
    SELECT w.bucket, lv.level, coalesce(c.n, 0) AS n, w.worst FROM w CROSS JOIN lv LEFT JOIN c ON c.bucket = w.bucket AND c.level = lv.level"""


@query("ag13_ordinal_max", "AG13", _LEVELS)
@query("ag13_ordinal_max_all", "AG13", _LEVELS)
def ordinal_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; ag13_ordinal_max is its sample."""
    return _levels(table(spark, sf_dir, "events"))


@query(
    "ag14_mode_tiebreak", "AG14",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, struct_pack(a := n, b := CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)) AS rule, max(n) AS n FROM c GROUP BY user_id""",
)
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.mode(table(spark, sf_dir, "events"), "user_id", "event_type", ("error", "purchase", "signup", "click", "view")).select("user_id", F.col("event_type").alias("rule"), "n")


@query(
    "ag16_change_queue", "AG16 SC7 SM7 AG20",
    """WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, arg_min(event_type, event_id) AS first_type FROM once GROUP BY user_id""",
)
def change_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    once = mg.latest(e, ["user_id", "event_type", "day"], "event_id")
    return once.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.min_by("event_type", "event_id").alias("first_type"))


@query(
    "ag17_flags", "AG17 SK10",
    """SELECT user_id, bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'purchase') AS has_purchase FROM events GROUP BY user_id""",
)
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("view", "click", "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == k).alias(f"has_{k}") for k in kinds])


@query(
    "jn2_unique_match", "JN2 JN4 JN9 GR2 FN11",
    """WITH r AS (SELECT c_custkey, c_nationkey, round(c_acctbal / 500)::BIGINT AS ref FROM customer), t AS (SELECT s_suppkey, s_nationkey, round(s_acctbal / 500)::BIGINT AS ref FROM supplier),
    j AS (SELECT c_custkey, s_suppkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM r JOIN t ON r.c_nationkey = t.s_nationkey AND r.ref = t.ref)
    SELECT c_custkey, s_suppkey FROM j WHERE n = 1 AND c_custkey <> s_suppkey""",
)
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _reference_sides(spark, sf_dir)
    return mg.resolve_unique(*sides, ["nation", "ref"], "c_custkey", "s_suppkey").where("c_custkey <> s_suppkey").select("c_custkey", "s_suppkey")


def _reference_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal") / 500).cast("long").alias("ref"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.round(F.col("s_acctbal") / 500).cast("long").alias("ref"))
    return c, s


@query(
    "jn3_audit", "JN3",
    """WITH r AS (SELECT c_custkey, c_nationkey, round(c_acctbal / 500)::BIGINT AS ref FROM customer), t AS (SELECT s_suppkey, s_nationkey, round(s_acctbal / 500)::BIGINT AS ref FROM supplier)
    SELECT c_custkey, count(s_suppkey) AS n, CASE count(s_suppkey) WHEN 0 THEN 'unresolved_external' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS targets
    FROM r LEFT JOIN t ON r.c_nationkey = t.s_nationkey AND r.ref = t.ref GROUP BY c_custkey""",
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.resolution_audit(*_reference_sides(spark, sf_dir), ["nation", "ref"], "c_custkey", "s_suppkey")


def _marker_links(parts: DataFrame, marking: DataFrame) -> DataFrame:
    p = parts.select("p_partkey", "p_brand", "p_type")
    k = marking.select(F.col("p_brand").alias("b"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("marker")).distinct()
    links = p.join(k, (F.col("p_brand") == F.col("b")) & F.contains("p_type", "marker")).select("p_partkey", "marker")
    return mg.nest(p, links, "p_partkey", "marker", "markers", "none")


_LINKS = """WITH k AS (SELECT DISTINCT p_brand AS b, split_part(p_type, ' ', 1) AS marker FROM part),
    l AS (SELECT p_partkey, marker FROM part p JOIN k ON p.p_brand = k.b AND contains(p.p_type, k.marker))
    SELECT p.p_partkey, count(l.marker) AS n, coalesce(string_agg(l.marker, ',' ORDER BY l.marker), 'none') AS markers FROM part p LEFT JOIN l USING (p_partkey) GROUP BY p.p_partkey"""


@query("jn5_appendix_links", "JN5 JN6", _LINKS)
@query("jn5_appendix_links_all", "JN5 JN6", _LINKS)
def appendix_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts against all distinct (brand, marker) pairs."""
    part = table(spark, sf_dir, "part")
    return _marker_links(part, part)


@query(
    "jn8_cascade", "JN8 JN15",
    """SELECT c.c_custkey, coalesce(a.s_suppkey, b.s_suppkey, d.s_suppkey) AS found, CASE WHEN a.s_suppkey IS NOT NULL THEN 1 WHEN b.s_suppkey IS NOT NULL THEN 2 WHEN d.s_suppkey IS NOT NULL THEN 3 END AS tier FROM customer c
    LEFT JOIN (SELECT s_suppkey AS k, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) a ON a.k = c.c_custkey
    LEFT JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_suppkey % 9 = 0 GROUP BY 1) b ON b.k = c.c_nationkey
    LEFT JOIN (SELECT n_regionkey AS k, min(s_suppkey) AS s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 = 1 GROUP BY 1) d ON d.k = (SELECT n_regionkey FROM nation WHERE n_nationkey = c.c_nationkey)""",
)
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are 25 rows at any scale
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    tiers = [
        ("c_custkey", s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("found"))),
        ("c_nationkey", s.where("s_suppkey % 9 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("found"))),
        ("n_regionkey", s.where("s_suppkey % 5 = 1").groupBy(F.col("n_regionkey").alias("k")).agg(F.min("s_suppkey").alias("found"))),
    ]
    return mg.cascade(c, tiers).select("c_custkey", "found", "tier")


@query("jn11_prefix", "", """WITH k AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS head FROM part) SELECT head, count(*) AS n, min(p_partkey) AS first_part FROM part JOIN k ON starts_with(p_type, head) GROUP BY head""")
def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    heads = small(part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head")).distinct())
    return part.join(heads, F.startswith("p_type", "head")).groupBy("head").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query(
    "jn17_containment", "JN17",
    """SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) GROUP BY item_id""",
)
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    names = table(spark, sf_dir, "benchmark").select("item_id", plain("text").alias("name"))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain("text").alias("text"))
    return containing(docs, names, "doc_id", "text", "item_id", "name").groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "jn18_members", "JN18 WN10 PJ10",
    """SELECT conv_id, count(*) AS n, string_agg(turn::VARCHAR || ':' || role, ',' ORDER BY turn) AS members, substr(string_agg('[' || turn::VARCHAR || '] ' || text, chr(10) ORDER BY turn), 1, 500) AS body FROM conversations GROUP BY conv_id""",
)
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "text")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.array_join(mg.in_order(F.concat_ws(":", F.col("turn").cast("string"), "role"), "turn"), ",").alias("members"), F.substring(F.array_join(mg.in_order(line, "turn"), "\n"), 1, 500).alias("body")
    )


@query("jn20_route", "JN20 SC20 FL19", """SELECT CASE event_type WHEN 'purchase' THEN 'relation' WHEN 'signup' THEN 'case' ELSE 'law' END AS collection, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0) GROUP BY 1""")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = e.where("event_type = 'error' AND event_id % 50 = 0").select("user_id").distinct()
    kind = F.when(F.col("event_type") == "purchase", "relation").when(F.col("event_type") == "signup", "case").otherwise("law")
    return e.join(bad, "user_id", "left_anti").groupBy(kind.alias("collection")).agg(F.count("*").alias("n"))


@query(
    "wn11_dedup_levels", "WN11 FL11",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'N') WHERE r = 1""",
)
def dedup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong rows all stay; of the weak ones of a key only the highest."""
    rows = table(spark, sf_dir, "lineitem")
    weak = F.col("l_returnflag") == "N"
    best = F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy(F.desc("l_quantity"), "l_linenumber"))
    return rows.where(~weak).select("l_orderkey", "l_linenumber").unionAll(rows.where(weak).withColumn("r", best).where("r = 1").select("l_orderkey", "l_linenumber"))


@query(
    "wn12_unordered_pairs", "WN12",
    """WITH p AS (SELECT o_custkey % 50 AS a, o_orderkey % 50 AS b, o_totalprice AS w, o_orderkey FROM orders WHERE o_custkey % 50 <> o_orderkey % 50)
    SELECT a, b, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY w DESC, a, o_orderkey) AS r FROM p) WHERE r = 1""",
)
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b"), "o_totalprice", "o_orderkey").where("a <> b")
    return mg.one_per_pair(p, "a", "b", F.desc("o_totalprice"), F.col("a"), F.col("o_orderkey")).select("a", "b", "o_orderkey")


@query(
    "st1_snapshot_diff", "ST1 SM5",
    """WITH o AS (SELECT o_orderkey AS id, o_orderstatus || o_orderpriority AS v FROM orders WHERE o_orderkey % 10 <> 3), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus || o_orderpriority END AS v FROM orders WHERE o_orderkey % 10 <> 4)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS op, n.v FROM o FULL JOIN n ON o.id = n.id WHERE o.v IS DISTINCT FROM n.v""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", "o_orderpriority").alias("v"))
    new = o.where("id % 10 <> 4").withColumn("v", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("v")))
    return mg.snapshot_diff(o.where("id % 10 <> 3"), new, "id").select("id", "op", "v")


@query(
    "st2_ordered_union", "ST2",
    """WITH l AS (SELECT user_id, array_agg(event_type ORDER BY event_id) FILTER (event_id % 2 = 0) AS a, array_agg(event_type ORDER BY event_id) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id),
    e AS (SELECT user_id, unnest(list_concat(coalesce(a, []), coalesce(b, []))) AS x, generate_subscripts(list_concat(coalesce(a, []), coalesce(b, [])), 1) AS i FROM l), f AS (SELECT user_id, x, min(i) AS i FROM e GROUP BY ALL)
    SELECT user_id, string_agg(x, ',' ORDER BY i) AS merged FROM f GROUP BY user_id""",
)
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import ordered_union as union

    e = table(spark, sf_dir, "events")
    part = lambda m: mg.in_order("event_type", "event_id", F.col("event_id") % 2 == m)
    return e.groupBy("user_id").agg(part(0).alias("a"), part(1).alias("b")).select("user_id", F.array_join(union(F.col("a"), F.col("b")), ",").alias("merged"))


@query(
    "st3_union", "ST3",
    """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""",
)
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("st7_missing_units", "ST7", "SELECT r_regionkey AS region, m AS month FROM region, (SELECT unnest(range(1, 13)) AS m) WHERE (r_regionkey, m) NOT IN (SELECT o_orderkey % 5, month(o_orderdate) FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def missing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("month"))
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").select((F.col("o_orderkey") % 5).alias("region"), F.month("o_orderdate").alias("month")).distinct()
    return units.join(seen, ["region", "month"], "left_anti").select("region", "month")
