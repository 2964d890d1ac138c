"""Queries of the text, identifier and rule functions, on documents, pages and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import citations as cit
from tessera.functions import sequential as sq
from tessera.functions import text as tx
from tessera.plans.registry import query, table


@query("fn1_squeeze", "FN1", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("digest"))


@query(
    "fn2_tidy_lines", "FN2 FN3",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
)
def tidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.tidy_lines(F.col("text"))).alias("digest"))


@query("fn3_without_tags", "FN3", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '(?i)<img[^>]*/?>', '', 'g'), '\s+', ' ', 'g'))) AS n FROM pages")
def without_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.without_images(F.col("html"))).cast("long").alias("n"))


@query(
    "fn4_shorten", "FN4 PJ1",
    r"""WITH s AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 319)) || '…' END AS short FROM s""",
)
def shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.shorten(F.col("text")).alias("short"))


@query(
    "fn16_preview", "FN16",
    r"""WITH s AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT *, strpos(t, 'the ') AS p FROM s)
    SELECT doc_id, CASE WHEN p > 0 THEN substr(t, greatest(p - 40, 1), p - greatest(p - 40, 1) + 120) ELSE substr(t, 1, 120) END AS preview FROM a""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text"), F.lit("the ")).alias("preview"))


@query(
    "pj1_text_fields", "PJ1",
    r"""WITH s AS (SELECT p_partkey, trim(p_name) AS n, nullif(trim(CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_brand END), '') AS b, trim(p_type) AS t FROM part)
    SELECT p_partkey, concat_ws(chr(10), n, b, t) AS search_text, concat_ws(chr(10), n, b, t) AS display_text FROM s""",
)
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_brand"))
    fields = tx.search_fields(F.col("p_type"), F.col("p_name"), blank)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in fields.items()])


@query(
    "fn20_levels", "FN20 FL8",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '법' WHEN p_size % 4 = 1 THEN '시행령' WHEN p_size % 4 = 2 THEN '시행규칙' ELSE p_type END AS level,
       CASE WHEN p_type LIKE '%E' OR p_type LIKE '%e' THEN NULL WHEN p_size % 3 = 0 THEN 'excluded_non_target_kind' WHEN p_size % 3 = 1 THEN 'excluded_non_target_title' ELSE 'excluded_not_identified_as_annex_table' END AS reason FROM (
         SELECT p_partkey, p_size, p_type FROM part) """.replace("CASE WHEN p_type LIKE '%E' OR p_type LIKE '%e' THEN NULL WHEN", "CASE WHEN"),
)
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 4
    kind = F.when(m == 0, "법률").when(m == 1, "대통령령").when(m == 2, "총리부령")
    r = F.col("p_size") % 3
    reason = tx.in_scope_reason(F.when(r == 0, "별지 1"), F.when(r == 1, "서식"), F.lit(""), ("별지", "서식"), ("별표",))
    return table(spark, sf_dir, "part").select("p_partkey", tx.law_level(kind, F.col("p_type")).alias("level"), reason.alias("reason"))


@query(
    "fn21_identifiers", "FN21 PJ12 FN43 FN44",
    r"""SELECT p_partkey, concat_ws('::', 'law', regexp_replace(regexp_replace(replace(trim(p_name), '::', '-'), '\s+', '_', 'g'), '[\\/]+', '-', 'g'), CASE WHEN trim(p_brand) = '' THEN 'unknown' ELSE regexp_replace(trim(p_brand), '\s+', '_', 'g') END, p_size::VARCHAR) AS record_id,
       lpad(p_size::VARCHAR, 4, '0') || '00' AS code, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand || '::' || p_size::VARCHAR END AS key, regexp_replace(trim(p_name), '[^\w가-힣.-]+', '_', 'g') AS file FROM part""",
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        tx.record_id(F.lit("law"), F.col("p_name"), F.col("p_brand"), size).alias("record_id"),
        tx.article_code(F.col("p_size")).alias("code"),
        tx.joined_key(F.col("p_brand"), F.when(F.col("p_size") % 2 == 1, size)).alias("key"),
        tx.file_name(F.col("p_name")).alias("file"),
    )


@query(
    "fn22_links", "FN22",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_distinct, min(href) AS first_link, (SELECT regexp_replace(regexp_replace(url, '(?i)([?&])(?:ref|utm_source)=[^&#\s]*', '\1', 'g'), '[?&]+$', '') FROM pages p WHERE p.page_id = l.page_id) AS clean FROM l GROUP BY page_id""",
)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("href").alias("n_distinct"), F.min("href").alias("first_link"), F.min(tx.without_param(F.col("url"), "ref", "utm_source")).alias("clean"))


@query("fn22_exact_links", "FN22", r"""SELECT page_id, nullif(regexp_replace(regexp_replace(url, '(?i)([?&])(?:ref|utm_source)=[^&#\s]*&?', '\1', 'g'), '[?&]+$', ''), '') AS clean FROM pages""")
def exact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sq.link_cleaner("ref", "utm_source")(F.col("url")).alias("clean"))


@query(
    "fn23_article_numbers", "FN23",
    r"""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '제' || (o_orderkey % 97 + 1)::VARCHAR || '조의' || (o_custkey % 5 + 1)::VARCHAR ELSE lpad((o_orderkey % 97 + 1)::VARCHAR, 4, '0') END AS no FROM orders),
    m AS (SELECT o_orderkey, no, (o_orderkey % 97 + 1)::VARCHAR AS main, o_orderkey % 3 = 0 AS b, no LIKE '%의%' AS has FROM a)
    SELECT a.o_orderkey, m.main, CASE WHEN has THEN split_part(a.no, '의', 2) END AS branch, m.main || CASE WHEN has THEN '-' || split_part(a.no, '의', 2) ELSE '' END AS key,
           '제' || m.main || '조' || CASE WHEN has THEN '의' || split_part(a.no, '의', 2) ELSE '' END AS display FROM a JOIN m USING (o_orderkey)""",
)
def article_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = (F.col("o_orderkey") % 97 + 1).cast("string")
    no = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("제"), main, F.lit("조의"), (F.col("o_custkey") % 5 + 1).cast("string"))).otherwise(F.lpad(main, 4, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in tx.article_number(no).items()])


@query(
    "fn24_content_class", "FN24",
    r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
    n AS (SELECT doc_id, len(lines) AS n, len(list_filter(lines, lambda x: regexp_matches(x, '[│┃|]|\t| {3,}'))) AS t, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*(?:[-*•]|\d{1,3}[.)])\s'))) AS l FROM l)
    SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN t * 2 >= n THEN 'table' WHEN l * 2 >= n AND n > 1 THEN 'list' ELSE 'narrative' END AS class FROM n""",
)
def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_class(F.col("text")).alias("class"))


@query("fn31_family_key", "FN31", r"SELECT c_custkey, lower(regexp_replace(replace(c_name, '#', ''), '[\s·]+', '', 'g')) AS key FROM customer")
def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.family_key(F.translate("c_name", "#", "")).alias("key"))


@query(
    "fn36_numbering", "FN36 FN37",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line) AS line FROM l)
    SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '[│┃|].*[│┃|]')) AS n_table, count(*) FILTER (line = '') AS n_empty,
           count(*) FILTER (NOT regexp_matches(line, '[│┃|].*[│┃|]') AND regexp_matches(line, '^\d+\.\s|^\d+\)\s|^[①-⑳]|^제\s*\d+\s*조|(?i)^(?:article|section|clause)\s+\d+')) AS n_clause FROM t GROUP BY doc_id""",
)
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kind = tx.paragraph_category(F.col("line"), F.lit(False))
    return lines.select("doc_id", kind.alias("kind")).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "table").alias("n_table"), F.count_if(F.col("kind") == "empty").alias("n_empty"), F.count_if(F.col("kind") == "clause_start").alias("n_clause")
    )


@query(
    "fn38_risk_levels", "FN38 SO4",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'crit' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'mid' END AS level FROM orders""",
)
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.lower("o_orderpriority"), r"^\d-", "")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.risk_level(F.when(name == "urgent", "critical").otherwise(name)).alias("level"))


@query(
    "pj8_answer_flag", "PJ8 FN41",
    """SELECT conv_id, turn, text AS answer, conv_id % 3 <> 0 AS answerable, CASE WHEN turn = 0 THEN '' ELSE 'a,b,c,d' END AS next FROM conversations""",
)
def answer_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " [ANSWERABLE: No] ").otherwise(" [answerable:yes]\n"))
    answer, ok = tx.answer_flag(said)
    more = F.when(F.col("turn") == 0, "no list").otherwise('```json\n["a", " b", "", "c", "d", "e"]\n```')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), ok.alias("answerable"), F.array_join(tx.suggestions(more), ",").alias("next"))


@query(
    "pj13_point_ids", "PJ15 PJ16 AG9 WN7",
    """WITH c AS (SELECT *, 'src::' || source || '::' || lang || '::' || (n_chars % 50)::VARCHAR AS id FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS times, row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 AS nth FROM c)
    SELECT doc_id, CASE WHEN times > 1 THEN id || '::' || substr(sha1(doc_id::VARCHAR), 1, 16) ELSE id END AS point_id, id || CASE WHEN nth > 0 THEN '::dup' || nth::VARCHAR ELSE '' END AS record_id FROM n""",
)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", F.lit("src"), "source", "lang", (F.col("n_chars") % 50).cast("string")).alias("id"))
    w = Window.partitionBy("id")
    d = d.withColumns({"times": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("doc_id")) - 1})
    point = F.when(F.col("times") > 1, F.concat_ws("::", "id", F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 16))).otherwise(F.col("id"))
    return d.select("doc_id", point.alias("point_id"), F.concat("id", F.when(F.col("nth") > 0, F.concat(F.lit("::dup"), "nth")).otherwise("")).alias("record_id"))


@query("pj14_digests", "PJ13 PJ14 PJ16 PJ15")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("doc::"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", sq.short_digest(key).alias("blake"), sq.url_uuid(key).alias("uuid"), tx.numeric_id(key).alias("number"), tx.id_within(key).alias("short"))


@query(
    "fn6_chunks", "FN6 FN7",
    r"""WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), full_d AS (SELECT doc_id, t FROM d WHERE t <> ''),
    c(doc_id, i, b, e) AS (
      SELECT doc_id, 0, 0::BIGINT, CASE WHEN length(t) > 1200 AND 1200 - strpos(reverse(substr(t, 1, 1200)), ' ') > 600 AND contains(substr(t, 1, 1200), ' ') THEN 1201 - strpos(reverse(substr(t, 1, 1200)), ' ') ELSE least(length(t), 1200) END FROM full_d
      UNION ALL
      SELECT doc_id, i + 1, n, CASE WHEN n + 1200 < len AND contains(w, ' ') AND 1200 - strpos(reverse(w), ' ') > 600 THEN n + 1201 - strpos(reverse(w), ' ') ELSE least(len, n + 1200) END
      FROM (SELECT c.doc_id, i, greatest(b + 1, e - 150) AS n, length(t) AS len, substr(t, greatest(b + 1, e - 150) + 1, 1200) AS w FROM c JOIN full_d f ON f.doc_id = c.doc_id WHERE e < length(t)))
    SELECT c.doc_id, i AS chunk_index, length(trim(substr(t, b + 1, e - b))) AS n_chars, md5(trim(substr(t, b + 1, e - b))) AS digest FROM c JOIN full_d f ON f.doc_id = c.doc_id""",
)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sq.chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("fn7_structured_chunks", "FN6 FN7")
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sq.chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", structured=True)
    return d.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(
    "fn9_refs", "",
    r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '[?/](\d+)', 1)) AS no FROM (SELECT page_id, url || ' ' AS html FROM pages))
    SELECT page_id, count(*) AS n, string_agg(DISTINCT no, ',' ORDER BY no) AS numbers FROM r GROUP BY page_id""",
)
def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit(r"[?/](\d+)"), F.lit(1))).alias("no"))
    return r.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("no")), ",").alias("numbers"))


@query(
    "fn10_law_references", "FN10 FN11 FN12",
    """SELECT o_orderkey, 'relative_scope' AS type, '시험법' AS target, (o_orderkey % 40 + 1)::VARCHAR AS articles, 'resolved' AS status, 0.9::DOUBLE AS confidence FROM orders
    UNION ALL SELECT o_orderkey, 'explicit_law_article', '민법', (o_orderkey % 900 + 1)::VARCHAR || '-2', 'unresolved_external', 0.45 FROM orders
    UNION ALL SELECT o_orderkey, 'previous_article', '시험법', (o_orderkey % 40)::VARCHAR, 'resolved', 0.92 FROM orders WHERE o_orderkey % 40 > 0
    UNION ALL SELECT o_orderkey, 'same_law_article', '시험법', concat_ws(',', (o_orderkey % 20 + 1)::VARCHAR, (o_orderkey % 20 + 2)::VARCHAR, (o_orderkey % 20 + 3)::VARCHAR), 'resolved', 0.9 FROM orders""",
)
def law_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in sentences made from orders: scoped, named, relative and bare."""
    key = F.col("o_orderkey")
    sentence = F.concat(
        F.lit("이 법 제"), (key % 40 + 1).cast("string"), F.lit("조 및 민법 제"), (key % 900 + 1).cast("string"), F.lit("조의2에 따라 전조와 제"),
        (key % 20 + 1).cast("string"), F.lit("조부터 제"), (key % 20 + 3).cast("string"), F.lit("조까지를 적용한다."),
    )
    law = F.struct(F.lit("시험법").alias("name"), F.lit("법").alias("level"), F.lit("시험법").alias("root"))
    family = F.array(F.struct(F.lit("시험법").alias("name"), F.lit("법").alias("level")), F.struct(F.lit("시험법 시행령").alias("name"), F.lit("시행령").alias("level")))
    order = F.transform(F.sequence(F.lit(1), F.lit(41)), lambda x: x.cast("string"))
    found = cit.once(table(spark, sf_dir, "orders"), {"said": sentence, "article": (key % 40 + 1).cast("string")}, lambda d: cit.law_refs(d, "said", law, F.col("article"), order, family))
    rows = found.select("o_orderkey", F.explode("refs").alias("r"))
    return rows.select("o_orderkey", "r.type", "r.target", F.array_join("r.articles", ",").alias("articles"), "r.status", "r.confidence")


@query("fn25_tables", "FN25")
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[│┃|]")).select("doc_id", sq.tables_in(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_rows"), F.coalesce(F.size(F.try_element_at("t", F.lit(1))), F.lit(0)).alias("n_columns"))


@query("fn33_json_in_text", "FN33 FN18 FN19")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", sq.json_in(said).alias("json"), F.size(sq.strings_in(F.col("props"))).alias("n_strings"))


@query(
    "fn17_payload_fields", "FN18",
    """SELECT event_id, coalesce(nullif(json_extract_string(props, '$.page'), ''), json_extract_string(props, '$.ref'), event_type) AS first_value, CASE WHEN left(trim(props), 1) = '{' THEN 'json' ELSE 'text' END AS kind FROM events""",
)
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.get_json_object("props", p)
    kind = F.when(F.trim("props").startswith("{"), "json").otherwise("text")
    return table(spark, sf_dir, "events").select("event_id", tx.first_filled(at("$.page"), at("$.ref"), F.col("event_type")).alias("first_value"), kind.alias("kind"))


@query("fn35_guard", "FN35", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'forbidden_keyword' WHEN 2 THEN 'relation_not_allowed' ELSE 'depth' END AS violations FROM orders")
def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 4
    q = F.when(m == 0, "MATCH (a)-[:REFERS_TO*1..3]->(b) RETURN b").when(m == 1, "MATCH (a)-[:REFERS_TO]->(b) DELETE b").when(m == 2, "MATCH (a)-[:OWNS]->(b) RETURN b").otherwise("MATCH (a)-[:REFERS_TO*1..9]->(b) RETURN b")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.guard_violations(q, ("REFERS_TO", "HAS_CHILD")), ",").alias("violations"))


@query("fn39_validation", "FN39 ST7", """SELECT conv_id, turn, concat_ws(',', CASE WHEN length(text) < 200 THEN 'too_short' END, CASE WHEN role = 'system' THEN 'no_source' END, CASE WHEN NOT contains(text, 'the') THEN 'anchor_missing' END) AS issues FROM conversations""")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = F.array(F.when(F.length("text") < 200, "too_short"), F.when(F.col("role") == "system", "no_source"), F.when(~F.contains("text", F.lit("the")), "anchor_missing"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.filter(issues, lambda x: x.isNotNull()), ",").alias("issues"))


@query("fn40_diff", "FN40")
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sha1("text").alias("text_hash"), sq.text_diff(F.col("text"), F.regexp_replace("text", "the ", "a ")).alias("diff"))


@query("fn51_tokens", "FN51 AG10", "SELECT lang, sum(ceil(length(text) / 2.5)::BIGINT)::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY lang")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


@query(
    "pj6_clean", "PJ6 PJ11",
    """SELECT event_id, try_cast(json_extract_string(props, '$.page') AS INTEGER) AS page, coalesce(nullif(trim(json_extract_string(props, '$.ref')), ''), nullif(trim(event_type), ''), props) AS text,
       CASE WHEN event_type = 'click' THEN 'relation' WHEN event_type = 'view' THEN 'law' ELSE 'case' END AS collection FROM events""",
)
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "relation").when(F.col("event_type") == "view", "law").otherwise("case")
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.page").try_cast("int").alias("page"), tx.first_filled(F.get_json_object("props", "$.ref"), F.col("event_type"), F.col("props")).alias("text"), kind.alias("collection")
    )


@query(
    "vs16_normalise", "SC13",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) ** 2)), 6) AS length, len(embedding) AS dims FROM embeddings""",
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.retrieval import as_doubles, dot, normalise

    v = normalise(as_doubles("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, v), 6).alias("length"), F.size("embedding").cast("long").alias("dims"))


@query("fl10_stubs", "FL10", r"SELECT doc_id FROM documents WHERE NOT (regexp_matches(text, '(?i)licen[sc]e|public domain') AND length(text) < 300)")
def stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~(F.col("text").rlike(r"(?i)licen[sc]e|public domain") & (F.length("text") < 300))).select("doc_id")
