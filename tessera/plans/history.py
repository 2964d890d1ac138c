"""Queries over history, feedback and review tables: orders as questions, lineitems as their sources, labels as feedback, events as a review's
log, conversations as paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import merging as mg
from tessera.operators import review as rv
from tessera.plans.registry import query, table


@query(
    "jn14_page_total", "JN14 FL14 FL15 SO6",
    """WITH f AS (SELECT * FROM orders WHERE (o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE 'p') AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL 1 DAY)
    SELECT (SELECT count(*) FROM f) AS total, o_orderkey FROM (SELECT o_orderkey FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 10)""",
)
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rv.matching(table(spark, sf_dir, "orders"), {"o_orderpriority": "%urgent%", "o_orderstatus": "p"}, "o_orderdate", "1995-01-01", "1996-01-01")
    return rv.page(f, [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 10).select("total", "o_orderkey")


@query("so5_keyset", "SO5", "SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_id > 1000 ORDER BY event_id LIMIT 25")
def keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.after(table(spark, sf_dir, "events").where("user_id = 7"), "event_id", 1000, 25).select("event_id", "event_type")


@query(
    "so4_case_order", "SO4",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P'""",
)
def case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(9)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(tier, "o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", place.cast("long").alias("place"))


@query(
    "so10_detail", "SO10",
    """SELECT o_orderkey, o_orderstatus, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS sources FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 10 GROUP BY ALL""",
)
def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_custkey = 10").select("o_orderkey", "o_orderstatus")
    rows = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return rows.groupBy("o_orderkey", "o_orderstatus").agg(F.array_join(F.transform(items, lambda x: x.l_partkey.cast("string")), ",").alias("sources"))


@query(
    "sk8_upsert", "SK8 SK10",
    """WITH n AS (SELECT doc_id, 1 - quality AS quality, 1 AS t FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 5, 2 FROM labels WHERE doc_id % 9 = 0 UNION ALL SELECT -1, 7, 1),
    every AS (SELECT doc_id, quality, 0 AS t FROM labels UNION ALL SELECT * FROM n)
    SELECT doc_id, arg_max(quality, t) AS quality FROM every WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows win; a row whose parent is missing is not written."""
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(0).alias("t"))
    new = old.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(1).alias("t"))
    new = new.unionAll(old.where("doc_id % 9 = 0").select("doc_id", F.lit(5), F.lit(2))).unionAll(spark.sql("SELECT -1L, 7, 1"))
    return rv.upsert(old, new, ["doc_id"], "t", parents=table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "quality")


@query(
    "sk9_keep_decision", "SK9 WF2",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 AND d.doc_id % 4 = 0 THEN 'kept' ELSE 'new' END AS decision, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def keep_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new result replaces the old one but keeps a decision that was taken."""
    old = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("doc_id") % 4 == 0), "kept").alias("decision"), "toxic")
    new = table(spark, sf_dir, "documents").select("doc_id", F.lit("new").alias("decision"))
    return rv.keep_first(new, old, "doc_id", "decision").select("doc_id", "decision", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("sk11_seq", "SK11", "SELECT event_id, user_id, coalesce(b.top, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events LEFT JOIN (SELECT c_custkey AS user_id, max(c_nationkey)::BIGINT AS top FROM customer GROUP BY 1) b USING (user_id)")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("user_id")).agg(F.max("c_nationkey").cast("long").alias("top"))
    return rv.numbered(table(spark, sf_dir, "events"), top, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("sk12_delete", "SK12", "SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left, children = rv.delete_cascade(o, li, o.where("o_custkey % 10 = 0").select("o_orderkey"), "o_orderkey", "l_orderkey")
    return left.agg(F.lit("orders").alias("kind"), F.count("*").alias("n")).unionAll(children.agg(F.lit("lineitem"), F.count("*")))


@query(
    "wn9_carry_forward", "WN9 WN10",
    """WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS clause FROM conversations),
    d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, clause ORDER BY turn) - 1 AS part FROM c)
    SELECT conv_id, turn, clause::BIGINT AS clause, part FROM d""",
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn opens a clause; what follows belongs to it and is counted within it."""
    return rv.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "clause", "part")


@query(
    "wn10_clauses", "WN10",
    """WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS clause FROM conversations)
    SELECT conv_id, clause::BIGINT AS clause, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, arg_min(role, turn) AS title, clause = max(clause) OVER (PARTITION BY conv_id) AS is_last FROM c GROUP BY conv_id, clause""",
)
def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rv.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    out = parts.groupBy("conv_id", "clause").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"), F.min_by("role", "turn").alias("title"))
    return out.withColumn("is_last", F.col("clause") == F.max("clause").over(Window.partitionBy("conv_id")))


@query(
    "wn13_position", "WN13",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, turn, CASE WHEN n = 1 THEN 'only' WHEN r = 1 THEN 'start' WHEN r = n THEN 'end' ELSE 'middle' END AS position FROM p""",
)
def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").where(F.trim("text") != "").withColumns({"r": F.row_number().over(w.orderBy("turn")), "n": F.count("*").over(w)})
    name = F.when(F.col("n") == 1, "only").when(F.col("r") == 1, "start").when(F.col("r") == F.col("n"), "end").otherwise("middle")
    return rows.select("conv_id", "turn", name.alias("position"))


@query(
    "fl16_relevance", "FL16",
    """WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
    SELECT conv_id, sum(CASE WHEN r <= 8 AND contains(text, 'the ') THEN 2 ELSE 0 END + CASE WHEN r <= 12 AND contains(text, 'und') THEN 1 ELSE 0 END)::BIGINT AS score FROM p GROUP BY conv_id""",
)
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.keyword_score(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", [("the ", 8, 2), ("und", 12, 1)]).select("conv_id", "score")


@query(
    "wf2_requests", "WF2",
    """WITH f AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS risk FROM events), r AS (SELECT * FROM f WHERE risk >= 2)
    SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'accepted' WHEN event_id % 5 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM r""",
)
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("view", "click", "signup", "purchase", "error")])
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.array_position(order, F.col("event_type")) - 1).alias("risk")).where("risk >= 2")
    said = e.where("event_id % 5 < 2").select("event_id", F.when(F.col("event_id") % 5 == 0, "accepted").otherwise("rejected").alias("status"))
    return e.join(said, "event_id", "left").select("event_id", "user_id", F.coalesce("status", F.lit("pending")).alias("status"))


@query("sm6_last_status", "", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
