"""Queries of sources, collection steps and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequential as sq
from tessera.functions import text as tx
from tessera.operators import collecting as co
from tessera.operators import merging as mg
from tessera.plans.registry import query, table
from tessera.sources import files


@query("sc3_object_tree", "SC2 SC3", "SELECT 'n nationkey=' || n_nationkey::VARCHAR AS root_name, n_name AS law_name, n_regionkey AS level FROM nation")
def object_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a file in a tree of folders, found by the file's name; a file's folder names its root."""
    path = files.scratch_path(spark, "objects")
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.to_json(F.struct(F.col("n_name").alias("law_name"), F.col("n_regionkey").alias("level"))).alias("value"))
    n.repartition(F.col("n_nationkey")).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    return files.tree(spark, path, "part-*.txt", "law_name string, level int").select("root_name", "law_name", "level")


@query(
    "sk2_datasets", "SK2",
    "SELECT 'chunks' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'items', count(*) FROM benchmark",
)
def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets with a manifest of the rows that were written."""
    named = {"chunks": table(spark, sf_dir, "documents").select("doc_id", "lang"), "labels": table(spark, sf_dir, "labels"), "items": table(spark, sf_dir, "benchmark")}
    return files.write_datasets(named, files.scratch_path(spark, "datasets"), spark)


@query(
    "sc5_collected", "SC5 FL6",
    """WITH c AS (SELECT p_size AS page, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, page - row_number() OVER (ORDER BY page) AS gap FROM c),
    stop AS (SELECT min(page) AS page FROM r WHERE n < 20 OR gap <> (SELECT min(page) - 1 FROM c)), cut AS (SELECT p.* FROM part p, stop WHERE stop.page IS NULL OR p_size < stop.page OR (p_size = stop.page AND (SELECT gap FROM r WHERE r.page = stop.page) = (SELECT min(page) - 1 FROM c))),
    w AS (SELECT * FROM cut WHERE NOT contains(p_type, 'PLATED') AND (trim(p_name) = '' OR contains(p_name, 'a')))
    SELECT p_brand, p_name, p_type, arg_min(p_partkey, p_size::BIGINT * 1000000000 + p_partkey) AS first_part FROM w GROUP BY ALL""",
)
def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged list: pages of 20 until one is not full, kinds left out, a keyword in the title, one row of three keys."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", "p_size", F.col("p_partkey").alias("first_part"))
    wanted = co.wanted_items(co.until_short_page(p, "p_size", 20), "p_type", "p_name", ("PLATED",), F.lit("a"))
    return co.first_of_keys(wanted, ["p_brand", "p_name", "p_type"], ["p_size", "first_part"]).select("p_brand", "p_name", "p_type", "first_part")


_BODIES = """b AS (SELECT 'e' || event_id::VARCHAR AS id, '' AS kind, props AS body FROM events UNION ALL SELECT 'p' || page_id::VARCHAR, CASE WHEN page_id % 4 = 0 THEN 'Text/HTML; charset=utf-8' ELSE NULL END, ' ' || html FROM pages
    UNION ALL SELECT 'd' || doc_id::VARCHAR, NULL, text FROM documents UNION ALL SELECT 'n' || n_nationkey::VARCHAR, NULL, '<?xml version="1.0"?><n>' || n_name || '</n>' FROM nation
    UNION ALL SELECT 'r' || r_regionkey::VARCHAR, 'application/xml', CASE r_regionkey WHEN 0 THEN '{"result":"x","msg":"no"}' WHEN 1 THEN '{"msg":"no","more":1}' WHEN 2 THEN '{"result":"x"}' WHEN 3 THEN '[1]' ELSE '{"msg":"a"}' END FROM region)"""


@query(
    "sc8_formats", "SC8 FL17",
    f"""WITH {_BODIES} SELECT id, CASE WHEN contains(lower(kind), 'json') THEN 'json' WHEN contains(lower(kind), 'xml') THEN 'xml' WHEN contains(lower(kind), 'html') THEN 'html'
        WHEN left(trim(body), 1) IN ('{{', '[') THEN 'json' WHEN regexp_matches(trim(body), '^(?i)<(?:!doctype html|html)') THEN 'html' WHEN left(trim(body), 1) = '<' THEN 'xml' ELSE 'text' END AS format,
        id IN ('r0', 'r4') AS is_error FROM b""",
)
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of five tables: their format by content type, else by their beginning; objects that only say an error."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("string")
    r = F.col("r_regionkey")
    said = F.when(r == 0, '{"result":"x","msg":"no"}').when(r == 1, '{"msg":"no","more":1}').when(r == 2, '{"result":"x"}').when(r == 3, "[1]").otherwise('{"msg":"a"}')
    rows = t("events").select(key("e", "event_id"), F.lit("").alias("kind"), F.col("props").alias("body"))
    rows = rows.unionAll(t("pages").select(key("p", "page_id"), F.when(F.col("page_id") % 4 == 0, "Text/HTML; charset=utf-8"), F.concat(F.lit(" "), "html")))
    rows = rows.unionAll(t("documents").select(key("d", "doc_id"), none, "text"))
    rows = rows.unionAll(t("nation").select(key("n", "n_nationkey"), none, F.concat(F.lit('<?xml version="1.0"?><n>'), "n_name", F.lit("</n>"))))
    rows = rows.unionAll(t("region").select(key("r", "r_regionkey"), F.lit("application/xml"), said))
    return rows.select("id", co.response_format(F.col("kind"), F.col("body")).alias("format"), co.is_error_payload(F.col("body")).alias("is_error"))


@query(
    "sc9_requests", "SC9",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'unknown_endpoint' WHEN '4-NOT SPECIFIED' THEN 'disabled'
       WHEN '1-URGENT' THEN CASE WHEN o_orderstatus = 'P' THEN 'missing:status' ELSE '' END
       WHEN '2-HIGH' THEN CASE WHEN o_custkey % 2 = 0 OR o_orderstatus = 'O' THEN '' ELSE 'one_of:cust|open' END
       ELSE concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'missing:status' END, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'O' THEN 'needs:open' END) END AS faults FROM orders""",
)
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: required, one-of and conditional parameters by a registry of endpoints."""
    names = "endpoint string, enabled boolean, required array<string>, one_of array<string>, conditional array<struct<given:string,then:string>>"
    registry = [("1-URGENT", True, ["status"], [], []), ("2-HIGH", True, [], ["cust", "open"], []), ("3-MEDIUM", True, ["status"], [], [("cust", "open")]), ("4-NOT SPECIFIED", False, ["status"], [], [])]
    params = F.create_map(
        F.lit("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("cust"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")), F.lit("open"), F.when(F.col("o_orderstatus") == "O", "yes").otherwise(" ")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("endpoint"), params.alias("params"))
    return co.request_faults(rows, spark.createDataFrame(registry, names)).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


@query(
    "sc12_assets", "SC12",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]+)"', 1)) AS link FROM pages), t AS (SELECT page_id, link || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.HWP?v=1' WHEN 2 THEN '.png#x' ELSE '' END AS link FROM l),
    u AS (SELECT DISTINCT page_id AS id, 'https://files.example/' || ltrim(link, '/') AS url FROM t)
    SELECT id, url, CASE WHEN regexp_matches(url, '\.pdf$') THEN 'pdf' WHEN regexp_matches(url, '\.HWP\?v=1$') THEN 'hwp' WHEN regexp_matches(url, '\.png#x$') THEN 'image' ELSE 'other' END AS kind,
           CASE WHEN url IN (SELECT 'https://files.example/' || ltrim(link, '/') FROM t WHERE page_id % 10 = 0) THEN 'reuse' ELSE 'download' END AS action FROM u""",
)
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as files to fetch, by type; what pages of round numbers link to is there already."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]+)"'), F.lit(1))).alias("link"))
    m = F.col("page_id") % 4
    links = p.select(F.col("page_id").alias("id"), F.concat("link", F.when(m == 0, ".pdf").when(m == 1, ".HWP?v=1").when(m == 2, ".png#x").otherwise("")).alias("link"))
    known = links.where("id % 10 = 0").select(F.concat(F.lit("https://files.example/"), F.regexp_replace("link", "^/+", "")).alias("url"))
    return co.asset_candidates(links, "https://files.example", known)


@query(
    "sc11_best_extraction", "SC11 FN27",
    r"""WITH c AS (SELECT doc_id AS id, 0 AS p, 'layout' AS extractor, text FROM documents UNION ALL SELECT doc_id, 1, 'plain', regexp_replace(text, '\s+', ' ', 'g') FROM documents UNION ALL SELECT doc_id, 2, 'table', replace(text, ', ', ' | ') FROM documents),
    s AS (SELECT id, p, extractor, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) + 2 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) + 4 * len(regexp_extract_all(text, '[│┃|]|\t| {3,}')) AS score FROM c)
    SELECT id, extractor, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, p) = 1""",
)
def best_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extractions of each text, as extractors of one file would give them; the one that holds most stays."""
    d = table(spark, sf_dir, "documents")
    one = lambda name, text: d.select(F.col("doc_id").alias("id"), F.lit(name).alias("extractor"), text.alias("text"))
    rows = one("layout", F.col("text")).unionAll(one("plain", F.regexp_replace("text", r"(?U)\s+", " "))).unionAll(one("table", F.replace("text", F.lit(", "), F.lit(" | "))))
    return co.best_extraction(rows, ("layout", "plain", "table"))


@query(
    "sc17_paragraphs", "SC17 PJ19",
    r"""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM l),
    a AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT id, place, (before // 1500 + 1)::BIGINT AS page, CASE WHEN regexp_matches(line, '^\s{4,}\S.*\S\s{4,}$') THEN 'center' WHEN regexp_matches(line, '^\s{8,}\S') THEN 'right' ELSE 'left' END AS align,
           regexp_matches(line, '[│┃|]') AS "table", round(length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) / greatest(length(line), 1)::DOUBLE, 4) AS upper FROM a""",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paragraph rows with features, as a reader of office files hands them on."""
    return co.paragraph_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 1500).withColumn("place", F.col("place").cast("long"))


@query("sc19_embedded_lines", "SC19", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE vec_id % 5 <> 0 AND label <> 3")
def embedded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of vectors found by a glob; lines without an id or a vector are left out."""
    path = files.scratch_path(spark, "embedded")
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.when(F.col("vec_id") % 5 != 0, F.col("vec_id")).alias("vec_id"), "label", F.when(F.col("label") != 3, F.col("embedding")).alias("embedding"))
    files.write_json(rows, f"{path}/law")
    return files.embedded_rows(spark, f"{path}/*/*.json", rows.schema, "vec_id", "embedding").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


_HITS = """c AS (SELECT user_id AS law, event_type AS target, event_id, round(value, 0) AS ref FROM events), once AS (SELECT law, target, ref, min(event_id) AS event_id FROM c GROUP BY ALL)"""


@query(
    "sc21_candidates", "SC21 PJ7 FL20",
    f"""WITH {_HITS} SELECT 'law::' || law::VARCHAR || '::' || target || '::' || event_id::VARCHAR AS candidate_id, row_number() OVER (PARTITION BY law, target ORDER BY event_id) AS hit_rank,
        CASE target WHEN 'view' THEN NULL WHEN 'click' THEN NULL WHEN 'purchase' THEN NULL WHEN 'error' THEN 'target_disabled' ELSE 'unknown_target' END AS skip FROM once""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits of laws and targets: one row of three keys, ranks within law and target, and why a target is skipped."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("law"), F.col("event_type").alias("target"), F.round("value", 0).alias("ref"), "event_id")
    once = co.target_status(co.first_of_keys(e, ["law", "target", "ref"], ["event_id"]), "target", {"view": True, "click": True, "purchase": True, "error": False})
    rank = F.row_number().over(Window.partitionBy("law", "target").orderBy("event_id"))
    return once.select(tx.record_id(F.lit("law"), F.col("law"), F.col("target"), F.col("event_id")).alias("candidate_id"), rank.cast("long").alias("hit_rank"), "skip")


@query(
    "sc21_summary", "SC21 FL20",
    f"""WITH {_HITS} SELECT target, count(*) AS hits, count(DISTINCT law) AS laws FROM once WHERE target IN ('view', 'click', 'purchase') GROUP BY target""",
)
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enabled targets gave."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("law"), F.col("event_type").alias("target"), F.round("value", 0).alias("ref"), "event_id")
    once = co.target_status(co.first_of_keys(e, ["law", "target", "ref"], ["event_id"]), "target", {"view": True, "click": True, "purchase": True, "error": False})
    return once.where("skip IS NULL").groupBy("target").agg(F.count("*").alias("hits"), F.count_distinct("law").alias("laws"))


@query(
    "sc18_hydrated", "SC18 JN1 PJ17",
    """WITH c AS (SELECT l_orderkey AS case_id, l_returnflag AS source FROM lineitem), g AS (SELECT case_id, arg_min(source, CASE source WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS source, count(*) AS n FROM c GROUP BY case_id)
    SELECT case_id, source, n, CASE WHEN o_orderstatus = 'F' THEN 'reused' WHEN o_orderkey IS NOT NULL AND o_totalprice > 100000 THEN 'fetched' ELSE 'missing' END AS status FROM g LEFT JOIN orders ON o_orderkey = case_id""",
)
def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate group's primary source and how its row is come by; the legacy rows count only if there are none."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("source"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "case_id")
    rows = co.hydrate(c, o.where("o_totalprice > 100000"), o.where("o_orderstatus = 'F'"), ("R", "A"))
    legacy = c.select("case_id", "source", F.lit(0).cast("long").alias("n"), F.lit("legacy").alias("status"))
    return co.else_legacy(rows, legacy)


@query(
    "vs16_micro_batches", "VS16 SK4",
    """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, turn, ceil(length(text) / 2.5)::BIGINT AS n FROM conversations),
    b AS (SELECT conv_id, r, turn, 0 AS batch, n AS used, 1 AS held FROM t WHERE r = 1 UNION ALL
          SELECT t.conv_id, t.r, t.turn, CASE WHEN b.held >= 3 OR b.used + t.n > 400 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.held >= 3 OR b.used + t.n > 400 THEN t.n ELSE b.used + t.n END,
                 CASE WHEN b.held >= 3 OR b.used + t.n > 400 THEN 1 ELSE b.held + 1 END FROM b JOIN t ON t.conv_id = b.conv_id AND t.r = b.r + 1)
    SELECT conv_id, turn, batch::BIGINT AS batch FROM b""",
)
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one conversation, in order, in batches of at most three texts and 400 tokens."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("n"))
    return sq.batched(rows, "conv_id", "turn", "n", 3, 400)


@query(
    "sk6_graph_files", "SK6",
    "SELECT 'nodes/region' AS part, count(*) AS n FROM region UNION ALL SELECT 'nodes/nation', count(*) FROM nation UNION ALL SELECT 'nodes/customer', count(*) FROM customer UNION ALL SELECT 'edges/HAS_CHILD', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)",
)
def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as JSON files, a folder for each kind, read back and counted."""
    from tessera.plans.graph import edges, nodes

    top = files.scratch_path(spark, "graph")
    files.write_graph(nodes(spark, sf_dir), edges(spark, sf_dir), top)
    one = lambda what: spark.read.schema("id string, src string, kind string").json(f"{top}/{what}").groupBy(F.concat(F.lit(f"{what}/"), "kind").alias("part")).agg(F.count("*").alias("n"))
    return one("nodes").unionAll(one("edges"))


@query(
    "sk7_save_with_children", "SK7",
    """WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50) SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS parents, count(l_orderkey) AS children
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM bad) GROUP BY 1""",
)
def save_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are written with all their lines or, where one is unsound, not at all."""
    o, li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    parents, children = co.whole_families(o, li, "k", F.col("l_quantity") < 50)
    counts = children.groupBy("k").agg(F.count("*").alias("c"))
    return parents.join(counts, "k", "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("parents"), F.coalesce(F.sum("c"), F.lit(0)).alias("children"))


@query(
    "sk16_dynamic_update", "SK16",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'applied' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'someone' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 3 = 0 THEN '{"by":"b","note":"' || o_orderstatus || '","ok":"1"}' ELSE '{"by":"a","note":"' || o_orderstatus || '"}' END AS decision FROM orders""",
)
def dynamic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only given fields change; a decision is merged into the old one key by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = o.withColumn("decision", F.concat(F.lit('{"by":"a","note":"'), "o_orderstatus", F.lit('"}')))
    patch = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("applied").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 6 == 0, "someone").alias("o_orderpriority"), F.lit('{"ok":"1","by":"b"}').alias("decision"))
    return co.update_given(rows, patch, "o_orderkey", "decision")


@query(
    "sk13_embedding_files", "SK13 SK17 PJ9",
    """SELECT 'vectors' AS part, count(*) AS n, min(len(embedding)) AS dims FROM embeddings UNION ALL SELECT 'meta', count(*), NULL FROM embeddings UNION ALL SELECT 'handoff', count(*), NULL FROM embeddings WHERE label < 5""",
)
def embedding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and metadata written apart, rows of a collection without vectors handed on, and a manifest of what was written."""
    e = table(spark, sf_dir, "embeddings")
    return files.write_embeddings(e, "vec_id", "embedding", F.col("label") < 5, files.scratch_path(spark, "embedding-files"), spark)


@query(
    "sm4_patch_vectors", "SM4",
    """SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 'delete' WHEN vec_id % 10 = 4 THEN 'insert' ELSE 'update' END AS op, CASE WHEN vec_id % 10 = 3 THEN 0 ELSE len(embedding) END AS dims FROM embeddings WHERE vec_id % 10 IN (3, 4) OR vec_id % 7 = 0""",
)
def patch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows that a patch puts in or changes get vectors; its deletes are listed."""
    from tessera.functions.models import TableEmbedder

    e = table(spark, sf_dir, "embeddings")
    old, new = e.where("vec_id % 10 <> 4").select("vec_id", "label"), e.where("vec_id % 10 <> 3").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.col("label") + 100).otherwise(F.col("label")).alias("label"))
    patch = mg.snapshot_diff(old, new, "vec_id")
    put = TableEmbedder(e, "vec_id", "embedding").embed(patch.where("op <> 'delete'").select("vec_id", "op"))
    return put.select("vec_id", "op", F.size("vector").cast("long").alias("dims")).unionAll(patch.where("op = 'delete'").select("vec_id", "op", F.lit(0).cast("long")))


@query(
    "sk15_preview", "SK15",
    """WITH m AS (SELECT conv_id, turn, role, text, strpos(text, ' ') AS p FROM conversations), e AS (SELECT *, lambda_x FROM (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS lambda_x FROM m))
    SELECT conv_id, turn, CASE WHEN p > 1 THEN '<mark class="' || role || '">' || replace(replace(replace(substr(text, 1, p - 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</mark>' || replace(replace(replace(substr(text, p), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') ELSE lambda_x END AS html FROM e""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its first word marked; marks that overlap or lie outside are left out."""
    c = table(spark, sf_dir, "conversations")
    p = F.instr("text", " ")
    mark = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("finish"), F.col("role").alias("label"))
    zero, size = F.lit(0), F.length("text")
    marks = F.array(mark(zero, F.greatest(p - 1, zero)), mark(F.greatest(p - 2, zero), F.greatest(p - 2, zero)), mark(size, size + 4), mark(size + 1, size + 2))
    return c.select("conv_id", "turn", co.preview_html(F.col("text"), marks).alias("html"))
