"""Queries of references, article numbers, statute trees, appendices and text variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import citations as cit
from tessera.functions import sequential as sq
from tessera.functions import statutes as st
from tessera.plans.registry import query, table

_KEY = "(o_orderkey % 40 + 1)"


@query(
    "fn9_article_refs", "FN9",
    f"""SELECT o_orderkey, array_to_string(list_concat(list_transform(range({_KEY}, {_KEY} + o_orderkey % 4 + 1), lambda x: x::VARCHAR), [(o_orderkey % 90 + 200)::VARCHAR || '-' || (o_custkey % 8 + 2)::VARCHAR]), ',') AS keys,
       concat_ws('.', (o_orderkey % 5 + 1)::VARCHAR, (o_orderkey % 3 + 1)::VARCHAR) AS units FROM orders""",
)
def article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a citation list: a range written out, then one with a branch and units."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    said = F.concat(
        F.lit("제"), s(k % 90 + 200), F.lit(" 조의 "), s(F.col("o_custkey") % 8 + 2), F.lit("제"), s(k % 5 + 1), F.lit("항 제"), s(k % 3 + 1), F.lit("호 및 제"), s(k % 40 + 1), F.lit("조부터 제"), s(k % 40 + 1 + k % 4), F.lit("조까지의 규정에 따라")
    )
    rows = cit.once(table(spark, sf_dir, "orders"), {"said": said}, lambda d: cit.article_refs(d, "said", "r"), "r")
    unit = F.filter("r", lambda x: x.paragraph.isNotNull())[0]
    return rows.select("o_orderkey", F.array_join(F.transform("r", lambda x: x.key), ",").alias("keys"), F.concat_ws(".", unit.paragraph, unit.item).alias("units"))


@query(
    "fn10_reference_rows", "FN10 FN11 FN12",
    """SELECT o_orderkey, 1 AS place, 'relative_scope' AS type, '시험법' AS target, (o_orderkey % 40 + 1)::VARCHAR AS articles, 'resolved' AS status, 0.9::DOUBLE AS confidence FROM orders
    UNION ALL SELECT o_orderkey, 3, 'relative_scope', '시험법 시행령', (o_custkey % 9 + 1)::VARCHAR, 'resolved', 0.88 FROM orders
    UNION ALL SELECT o_orderkey, 2, 'explicit_law_article', '민법', (o_orderkey % 900 + 1)::VARCHAR || '-2', 'unresolved_external', 0.45 FROM orders
    UNION ALL SELECT o_orderkey, 4, 'previous_article', '시험법', (o_orderkey % 40)::VARCHAR, 'resolved', 0.92 FROM orders WHERE o_orderkey % 40 > 0
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 40 > 0 THEN 5 ELSE 4 END, 'same_law_article', '시험법', concat_ws(',', (o_orderkey % 20 + 1)::VARCHAR, (o_orderkey % 20 + 2)::VARCHAR, (o_orderkey % 20 + 3)::VARCHAR), 'resolved', 0.9 FROM orders""",
)
def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by pointer, by level, by name, by neighbourhood and bare ones, in order of their kind."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    said = F.concat(
        F.lit("이 법 제"), s(k % 40 + 1), F.lit("조 및 민법 제"), s(k % 900 + 1), F.lit("조의2에 따라 전조와 제"), s(k % 20 + 1), F.lit("조부터 제"), s(k % 20 + 3), F.lit("조까지를 적용하고 시행령 제"), s(F.col("o_custkey") % 9 + 1), F.lit("조에 따른다.")
    )
    law = F.struct(F.lit("시험법").alias("name"), F.lit("법").alias("level"), F.lit("시험법").alias("root"))
    family = F.array(F.struct(F.lit("시험법").alias("name"), F.lit("법").alias("level")), F.struct(F.lit("시험법 시행령").alias("name"), F.lit("시행령").alias("level")))
    order = F.transform(F.sequence(F.lit(1), F.lit(41)), lambda x: x.cast("string"))
    found = cit.once(table(spark, sf_dir, "orders"), {"said": said, "article": s(k % 40 + 1)}, lambda d: cit.law_refs(d, "said", law, F.col("article"), order, family))
    rows = found.select("o_orderkey", F.posexplode("refs").alias("place", "r"))
    return rows.select("o_orderkey", (F.col("place") + 1).alias("place"), "r.type", "r.target", F.array_join("r.articles", ",").alias("articles"), "r.status", "r.confidence")


@query(
    "fn14_named_refs", "FN14",
    """SELECT o_orderkey, '민법' AS law, (o_orderkey % 700 + 1)::VARCHAR AS key FROM orders UNION ALL SELECT o_orderkey, '민법', (o_orderkey % 700 + 3)::VARCHAR FROM orders
    UNION ALL SELECT o_orderkey, '상가건물 임대차보호법', (o_custkey % 20 + 1)::VARCHAR || '-2' FROM orders""",
)
def named_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after each mention of a known law and in the lists that go on from it; another law's are not theirs."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    said = F.concat(
        F.lit("판결은 민법 제"), s(k % 700 + 1), F.lit("조, 제"), s(k % 700 + 3), F.lit("조와 형법 제9조를 든다. 또한 상가건물 임대차보호법 제"), s(F.col("o_custkey") % 20 + 1), F.lit("조의2 제1항을 본다.\n제77조")
    )
    found = cit.once(table(spark, sf_dir, "orders"), {"said": said}, lambda d: cit.named_refs(d, "said", F.array(F.lit("민법"), F.lit("상가건물 임대차보호법"))))
    return found.select("o_orderkey", F.explode("refs").alias("r")).select("o_orderkey", "r.law", "r.key")


@query(
    "fn15_structured_refs", "FN15",
    """SELECT o_orderkey, '민법' AS law, (o_orderkey % 50 + 1)::VARCHAR AS key FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, '상법', (o_custkey % 50 + 1)::VARCHAR FROM orders WHERE o_orderstatus <> 'P'""",
)
def structured_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a record's own field, whichever of its names the field has."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("민법 제"), (k % 50 + 1).cast("string"), F.lit("조 / 상법 제"), (F.col("o_custkey") % 50 + 1).cast("string"), F.lit("조"))
    s = F.col("o_orderstatus")
    body = F.when(s == "F", F.to_json(F.struct(said.alias("참조조문")))).when(s == "O", F.to_json(F.struct(F.lit(" ").alias("참조조문"), said.alias("관계법령")))).otherwise('{"other": "민법 제1조"}')
    found = cit.once(table(spark, sf_dir, "orders"), {"said": st.field_text(body, ("참조조문", "관계법령"))}, lambda d: cit.named_refs(d, "said", F.array(F.lit("민법"), F.lit("상법"))))
    return found.select("o_orderkey", F.explode("refs").alias("r")).select("o_orderkey", "r.law", "r.key")


@query(
    "fn45_noise_names", "FN45 FL12",
    """SELECT o_orderkey, o_orderkey % 6 IN (1, 2, 4, 5) AS noise FROM orders""",
)
def noise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before a citation that are no law's own."""
    m, n = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 100).cast("string")
    name = F.when(m == 0, F.concat(F.lit("제도"), n, F.lit("법"))).when(m == 1, "법 시행령").when(m == 2, F.concat(F.lit("장관이 정한 제도"), n, F.lit("법"))).when(m == 3, F.concat(F.lit("주택"), n, F.lit(" 공급규칙"))).when(m == 4, F.concat(F.lit("특례("), n, F.lit(")"))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", cit.is_noise_name(name).alias("noise"))


@query("fl7_allowed_levels", "FL7", "SELECT p_partkey, p_size % 4 IN (1, 2) OR p_size % 4 = 3 AS direct, p_size % 4 = 0 AS laws, true AS any_level FROM part")
def allowed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels against allow-lists; one entry stands for both levels below a law, an empty list for all."""
    m = F.col("p_size") % 4
    level = F.when(m == 0, "법").when(m == 1, "시행령").when(m == 2, "시행규칙").otherwise("기타")
    return table(spark, sf_dir, "part").select("p_partkey", st.allowed_level(level, (st.DIRECT_RULES, "기타")).alias("direct"), st.allowed_level(level, ("법",)).alias("laws"), st.allowed_level(level, ()).alias("any_level"))


_PARTS = r"p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), q AS (SELECT doc_id, trim(split_part(line, '.', 1)) AS title, trim(line) AS body FROM p)"


@query(
    "fl9_searchable_parts", "FL9 FL13 FN29",
    rf"""WITH {_PARTS}, d AS (SELECT DISTINCT doc_id, title, body FROM q) SELECT doc_id, count(*) AS n, count(*) FILTER (body <> '' AND NOT (regexp_matches(body, '[│┃|]|\t| {{3,}}')) AND NOT regexp_matches(body, '^\s*(?:[-*•]|\d{{1,3}}[.)])\s') AND title <> body) AS searchable FROM d GROUP BY doc_id""",
)
def searchable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a text, each (title, body) once; those that are narrative and more than their title are searched."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    parts = lines.select("doc_id", F.trim(F.split("line", r"\.")[0]).alias("title"), F.trim("line").alias("body"))
    kept = st.distinct_parts(parts, ["doc_id", "title", "body"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(st.searchable_part(F.col("title"), F.col("body"))).alias("searchable"))


@query(
    "ag15_modal_columns", "AG15",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, length(line) - length(replace(line, '|', '')) + 1 AS n FROM l WHERE contains(line, '|')),
    m AS (SELECT doc_id, n, count(*) AS times FROM c GROUP BY ALL) SELECT doc_id, n AS columns, times, (SELECT sum(times) FROM m x WHERE x.doc_id = m.doc_id)::BIGINT AS rows FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, n DESC) = 1""",
)
def modal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns most table lines of a text have, of equal counts the larger, and how many lines agree."""
    return st.table_layout(table(spark, sf_dir, "documents"), "doc_id", "text", "|")


@query(
    "so7_article_order", "SO7",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 97 + 1), CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5 + 1) ELSE 0 END, o_orderkey) AS place FROM orders""",
)
def article_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a law in the order of their numbers, not of their text: 2 before 10, 3 before 3-2."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    no = F.concat(F.lit("제"), (k % 97 + 1).cast("string"), F.lit("조"), F.when(k % 3 == 0, F.concat(F.lit("의"), (k % 5 + 1).cast("string"))).otherwise(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *st.article_sort_key(no))
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("sort_main", "sort_branch", "o_orderkey")).cast("long").alias("place"))


@query(
    "fn28_article_tree", "FN28 FN30 FN48",
    """SELECT o_orderkey, '제' || (o_orderkey % 9 + 1)::VARCHAR || '조(' || o_orderstatus || ')' || chr(10) || '  ① ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '    1. ' || o_custkey::VARCHAR || chr(10) || '      가. x' ELSE '' END AS text, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS parts FROM orders""",
)
def article_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested article JSON, whose units are a list or a single object, as indented text."""
    k = F.col("o_orderkey")
    sub = F.lit('{"no":"가.","text":"x"}')
    item = F.concat(F.lit('{"no":"1.","text":"'), F.col("o_custkey").cast("string"), F.lit('","subitems":'), sub, F.lit("}"))
    paragraph = F.concat(F.lit('{"no":"①","text":"'), "o_orderpriority", F.lit('"'), F.when(k % 2 == 0, F.concat(F.lit(',"items":['), item, F.lit("]"))).otherwise(""), F.lit("}"))
    body = F.concat(F.lit('{"no":"제'), (k % 9 + 1).cast("string"), F.lit('조","title":"'), "o_orderstatus", F.lit('","paragraphs":'), F.when(k % 3 == 0, F.concat(F.lit("["), paragraph, F.lit("]"))).otherwise(paragraph), F.lit("}"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", st.article_tree(body).alias("t"))
    return rows.select("o_orderkey", st.tree_text(F.col("t")).alias("text"), st.tree_parts(F.col("t")).alias("parts"))


@query(
    "fn49_text_variants", "FN49",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS raw, CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS clean, CASE WHEN p_size % 5 = 0 THEN 'a' || chr(10) || 'b' ELSE p_brand END AS part FROM part""",
)
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw or the clean form of a text, each falling back on the other; lists written as text are unwrapped."""
    z = F.col("p_size")
    raw, clean = F.when(z % 3 == 0, F.col("p_name")).otherwise(" "), F.when((z % 2 == 0) | (z % 3 != 0), F.col("p_type"))
    said = F.when(z % 5 == 0, "['a', 'b']").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", st.text_variant(raw, clean, "raw").alias("raw"), st.text_variant(raw, clean, "clean").alias("clean"), st.unwrapped(said).alias("part"))


@query(
    "fn50_bundle_text", "FN50",
    """SELECT p_partkey, concat_ws(chr(10), '[별표 ' || p_size::VARCHAR || ']', p_name, CASE WHEN p_size % 2 = 0 THEN p_type END) AS bundle, '별표 ' || p_size::VARCHAR || ',별표' || p_size::VARCHAR || ',[별표 ' || p_size::VARCHAR || ']' AS markers FROM part""",
)
def bundle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An appendix as one text, sections that repeat left out, and the ways its marker is written."""
    no = F.col("p_size").cast("string")
    sections = F.array(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.concat(F.lit(" "), "p_name"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", st.bundle_text(F.lit("별표"), no, sections).alias("bundle"), F.array_join(st.marker_forms(F.lit("별표"), no), ",").alias("markers"))


@query(
    "fn26_appendix_class", "FN26 FN27",
    r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents), n AS (SELECT doc_id, text, len(lines) AS n, len(list_filter(lines, lambda x: regexp_matches(x, '[│┃|]|\t| {3,}'))) AS t, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*(?:[-*•]|\d{1,3}[.)])\s'))) AS li FROM l),
    c AS (SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN t * 2 >= n THEN 'table' WHEN li * 2 >= n AND n > 1 THEN 'list' ELSE 'narrative' END AS shape FROM n)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'form' WHEN shape = 'empty' THEN 'image_only' WHEN shape = 'table' THEN 'table' ELSE 'text' END AS class, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN shape = 'table' THEN 'markdown' WHEN shape = 'empty' THEN 'asset' ELSE 'api' END AS source FROM c""",
)
def appendix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appendices by title and shape, and which of their texts is used."""
    title = F.when(F.col("doc_id") % 5 == 0, "별지 서식").otherwise("별표")
    kind = st.appendix_class(title, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("class"), st.text_source(kind).alias("source"))


@query(
    "fn32_appendix_rows", "FN32",
    r"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents) SELECT doc_id, 'raw' AS variant, 0 AS part, length(text) AS n FROM d WHERE trim(text) <> '' UNION ALL SELECT doc_id, 'clean', 0, length(clean) FROM d WHERE clean <> ''
    UNION ALL SELECT doc_id, 'table', row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1, length(line) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d) WHERE contains(line, '|')""",
)
def appendix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw, a clean and a row for each table line of each text."""
    return st.appendix_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "variant", "part", F.length("value").cast("long").alias("n"))


@query(
    "fn8_block_chunks", "FN8",
    """WITH RECURSIVE t AS (SELECT conv_id, 'case ' || conv_id::VARCHAR AS header, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, '#' || turn::VARCHAR || ' ' || role AS b FROM conversations),
    c AS (SELECT conv_id, header, r, 0 AS chunk, b AS held FROM t WHERE r = 1 UNION ALL
          SELECT t.conv_id, t.header, t.r, CASE WHEN length(c.held) + 1 + length(t.b) > 40 - length(t.header) - 1 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN length(c.held) + 1 + length(t.b) > 40 - length(t.header) - 1 THEN t.b ELSE c.held || chr(10) || t.b END FROM c JOIN t ON t.conv_id = c.conv_id AND t.r = c.r + 1)
    SELECT conv_id, chunk AS place, header || chr(10) || arg_max(held, r) AS chunk FROM c GROUP BY conv_id, header, chunk""",
)
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a case packed to size, each chunk under the case's header."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit(" "), "role").alias("b"))
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x.b).alias("blocks"))
    rows = lists.select("conv_id", F.posexplode(sq.blocks_of(F.col("blocks"), F.concat(F.lit("case "), F.col("conv_id").cast("string")), F.lit(40))).alias("place", "chunk"))
    return rows.select("conv_id", "place", "chunk")


@query(
    "pj18_defaults", "PJ18 PJ4 PJ5",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'legacy' ELSE o_orderstatus END AS model, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS rank, CASE o_orderkey % 4 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score,
       CASE WHEN o_orderstatus = 'F' THEN 'case ' || o_custkey::VARCHAR || ' cites ' || o_orderkey::VARCHAR WHEN o_orderstatus = 'O' THEN 'law ' || o_custkey::VARCHAR || ' rules ' || o_orderkey::VARCHAR ELSE o_custkey::VARCHAR || ' - ' || o_orderkey::VARCHAR END AS text,
       CASE WHEN o_orderstatus = 'F' THEN 'citation' WHEN o_orderstatus = 'O' THEN 'rule' ELSE 'other' END AS profile FROM orders""",
)
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation rows of an older form: missing fields filled, lenient numbers, a text and a profile by model."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(s != "P", s).otherwise(" ").alias("model"), F.when(k % 4 == 0, " 3 ").when(k % 4 == 1, "4.0").when(k % 4 == 2, "x").alias("rank"), F.when(k % 4 == 1, "0.5").when(k % 4 == 2, "").alias("score"),
        F.col("o_custkey").cast("string").alias("source"), k.cast("string").alias("target"),
    )
    out = st.with_defaults(rows, {"model": "legacy"}, {"rank": 0, "score": 0.0})
    text = st.by_model({"F": "case {source} cites {target}", "O": "law {source} rules {target}"}, "{source} - {target}", ("source", "target"))
    return out.select("o_orderkey", "model", "rank", "score", text.alias("text"), st.looked_up({"F": "citation", "O": "rule"}, F.col("model"), "other").alias("profile"))


@query("pj14_uuids", "PJ14 PJ15 PJ16", """WITH d AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc::' || doc_id::VARCHAR)) AS h, sha1('doc::' || doc_id::VARCHAR) AS s FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid,
           (('0x' || substr(s, 1, 16))::UBIGINT)::VARCHAR AS number, 'doc::' || doc_id::VARCHAR AS short, 'sha1::' || sha1(repeat('doc::' || doc_id::VARCHAR, 200)) AS long_id FROM d""")
def uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of points: a name-based UUID, a number from a digest, and the id itself where it is short."""
    from tessera.functions import text as tx

    key = F.concat(F.lit("doc::"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", sq.url_uuid(key).alias("uuid"), tx.numeric_id(key).cast("string").alias("number"), tx.id_within(key).alias("short"), tx.id_within(F.repeat(key, 200)).alias("long_id"))


@query(
    "fn51_token_cut", "FN51",
    "SELECT doc_id, ceil(length(text) / 2.5)::BIGINT AS tokens, least(length(text), 250) AS cut FROM documents",
)
def token_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated number of tokens, and the text cut to 100 of them."""
    from tessera.functions import text as tx

    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), F.length(st.cut_to_tokens(F.col("text"), 100)).cast("long").alias("cut"))




@query("pj13_blake_point_ids", "PJ13")
def blake_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id of its own for every row: the id, or the id with an eight-byte digest of the row where the id repeats."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", F.lit("src"), "source", "lang").alias("id"))
    return sq.point_ids(d, "id", F.concat_ws("|", "id", F.col("doc_id").cast("string")), "doc_id")
