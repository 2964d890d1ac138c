"""Event and incremental queries: windows over time, deltas, patches, and sources and sinks exercised end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import merging as mg
from tessera.plans.registry import query, table
from tessera.sources import files
from tessera.streaming import events as ev


@query(
    "sm_tumbling", "",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "sm_session", "",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.sessions(table(spark, sf_dir, "events"), "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


@query("sm_event_tail", "SM7", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("r", r).where("r <= 3").select("event_id", "user_id", "event_type")


def _queue(e: DataFrame, customers: DataFrame) -> DataFrame:
    feed = lambda rows, kind: rows.select(F.col("user_id").alias("law"), "event_id", F.lit(kind).alias("kind"))
    t = F.col("event_type")
    feeds = feed(e.where(t == "error"), "deleted").unionByName(feed(e.where(t == "purchase"), "law_changed")).unionByName(feed(e.where(~t.isin("error", "purchase")), "article_changed"))
    queue = mg.latest(feeds, ["event_id"], "law").groupBy("law").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    roots = customers.select(F.col("c_custkey").alias("law"), F.col("c_nationkey").alias("root"))
    return queue.join(roots, "law", "left").select("law", "n", "kinds", F.coalesce("root", F.lit(-1)).alias("root"))


_QUEUE = """WITH e AS (SELECT user_id AS law, event_id, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'law_changed' ELSE 'article_changed' END AS kind FROM events)
    SELECT law, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, coalesce(min(c_nationkey), -1) AS root FROM e LEFT JOIN customer ON c_custkey = law GROUP BY law"""


@query("sc7_delta_queue", "SC7 JN15", _QUEUE)
@query("sc7_delta_queue_all", "SC7 JN15", _QUEUE)
def delta_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds as one, grouped by what they change, with the root that each change falls under."""
    return _queue(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"))


@query(
    "sm3_apply_patch", "SM5 ST1",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 10 <> 4""",
)
def apply_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two snapshots, applied to the old one, is the new one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    new = o.where("id % 10 <> 4").withColumn("v", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("v")))
    old = o.where("id % 10 <> 3")
    return mg.apply_patch(old, mg.snapshot_diff(old, new, "id"), "id").select("id", "v")


@query(
    "sk3_bulk_lines", "SK3 SM5",
    """SELECT doc_id, 0 AS part, '{"index":{"_index":"docs","_id":"' || doc_id::VARCHAR || '"}}' AS line FROM documents UNION ALL SELECT doc_id, 1, '{"lang":"' || lang || '","n_chars":' || n_chars::VARCHAR || '}' FROM documents""",
)
def bulk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bulk_lines(table(spark, sf_dir, "documents"), "docs", "doc_id", ["lang", "n_chars"])


@query("sc14_vectors", "SC13 SC14", "SELECT label, count(*) AS n, min(len(embedding)) AS dims FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 GROUP BY label")
def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = files.checked_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return v.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query("wf7_gates", "WF7", "SELECT 'documents' AS name, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS odd FROM documents")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.agg(
        F.lit("documents").alias("name"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("odd")
    )


@query(
    "sc10_html_ids", "SC10",
    """SELECT page_id, len(regexp_extract_all(html, '<a href="/([^"]+)"', 1)) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""",
)
def html_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), F.lit(1))).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("sc5_paged_source", "", "SELECT n_nationkey AS id, n_name AS name, n_nationkey // 10 AS page FROM nation")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged source read one partition a page through the Python data source API; the fixture stands for the remote service."""
    from tessera.sources.paged import read_pages

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).orderBy("id")  # 25 rows at any scale
    return read_pages(spark, [(r.id, r["name"]) for r in rows.collect()], 10)


@query(
    "fl18_case_numbers", "FL18 FN13",
    """SELECT o_orderkey, (1990 + o_orderkey % 30)::VARCHAR || CASE o_orderkey % 3 WHEN 0 THEN '다' WHEN 1 THEN '헌바' ELSE '구합' END || (o_orderkey % 9999 + 1)::VARCHAR AS numbers FROM orders""",
)
def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case numbers in sentences made from orders: found, squeezed, each once, without the excluded one."""
    from tessera.functions.text import case_numbers as found

    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "다").when(k % 3 == 1, "헌바").otherwise("구합")
    number = F.concat((1990 + k % 30).cast("string"), F.lit(" "), kind, (k % 9999 + 1).cast("string"))
    said = F.concat(F.lit("대법원 "), number, F.lit(" 판결 및 2001다1 판결, "), number, F.lit(" 참조"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found(said, F.array(F.lit("2001다1"))), ",").alias("numbers"))


@query(
    "sc1_json_round_trip", "SC1 SK1",
    "SELECT conv_id, turn, role, length(text) AS n FROM conversations",
)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines in the shared folder and read back with their schema."""
    path = files.scratch_path(spark, "conversations-json")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    files.write_json(rows, path)
    return files.json_lines(spark, path, rows.schema).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("sc4_csv_gold", "SC4 SK14", "SELECT item_id::VARCHAR AS query, trim(text) AS text FROM benchmark")
def csv_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold set written as CSV in the shared folder and read back trimmed."""
    path = files.scratch_path(spark, "gold-csv")
    files.write_csv(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), "text"), path)
    return files.gold_set(spark, path, ["query", "text"])


@query("sk13_embed", "SK13", "SELECT vec_id, len(embedding) AS dims, label FROM embeddings")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from an embedder behind an interface: here the given table looks them up, as models are inputs."""
    from tessera.functions.models import TableEmbedder

    texts = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    out = TableEmbedder(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").embed(texts)
    return out.select("vec_id", F.size("vector").cast("long").alias("dims"), "label")


@query("wf6_stages", "GR1", "SELECT 'chunks' AS stage, count(*) AS n FROM documents WHERE length(trim(text)) >= 20 UNION ALL SELECT 'relations', count(*) FROM labels JOIN documents USING (doc_id)")
def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.where(F.length(F.trim("text")) >= 20).agg(F.lit("chunks").alias("stage"), F.count("*").alias("n"))
    return chunks.unionAll(table(spark, sf_dir, "labels").join(d.select("doc_id"), "doc_id").agg(F.lit("relations"), F.count("*")))
