"""Search queries: vector and keyword top-k, fusion, policies, context, on documents and embeddings.

Documents stand for chunks: source_id is doc_id, lang en stands for law rows and the other languages for case rows, source for the
law's name. The query vectors are those of three fixed vec_ids, the query terms three fixed lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sequential import pack_context
from tessera.operators import ranking as rk
from tessera.operators import retrieval as rt
from tessera.operators.containment import containing
from tessera.plans.registry import query, table

TERMS = [("q1", "the"), ("q1", "thand"), ("q1", "tion"), ("q2", "und"), ("q2", "heit"), ("q3", "elle"), ("q3", "eau"), ("q3", "des")]
VECTORS = [("q1", 3), ("q2", 17), ("q3", 42)]
_TERMS_SQL = ", ".join(f"('{q}', '{t}')" for q, t in TERMS)
_VECTORS_SQL = ", ".join(f"('{q}', {v})" for q, v in VECTORS)

_KIND = "CASE lang WHEN 'en' THEN 'law' WHEN 'de' THEN 'prec' WHEN 'fr' THEN 'detc' ELSE 'expc' END"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "text", "lang", "source", F.expr(_KIND).alias("doc_type"), F.col("source").alias("law_name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").alias("vector"), "vec_id", "label")


def query_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "query_id string, term string")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame(VECTORS, "query_id string, vec_id long")
    return table(spark, sf_dir, "embeddings").join(F.broadcast(ids), "vec_id").select("query_id", F.col("embedding").alias("vector"))


def vector_hits(spark: SparkSession, sf_dir: str, top: int = 30) -> DataFrame:
    return rt.vector_top(vectors(spark, sf_dir), query_vectors(spark, sf_dir), top)


def keyword_hits(spark: SparkSession, sf_dir: str, top: int = 30) -> DataFrame:
    return rt.keyword_top(chunks(spark, sf_dir), query_terms(spark), top)


_COSINE = f"""
wanted(query_id, vec_id) AS (VALUES {_VECTORS_SQL}),
vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
qv AS (SELECT query_id, v AS qv FROM wanted JOIN vec USING (vec_id)),
cosine AS (SELECT query_id, vec_id::VARCHAR AS source_id, list_cosine_similarity(v, qv) AS score FROM vec, qv),
vector_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, source_id) AS rank FROM cosine) WHERE rank <= 30)
"""
_BM25 = f"""
terms(query_id, term) AS (VALUES {_TERMS_SQL}),
docs AS (SELECT doc_id::VARCHAR AS source_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
word AS (SELECT source_id, len(w) AS dl, unnest(w) AS term FROM docs),
tf AS (SELECT source_id, dl, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, source_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
       FROM tf JOIN df USING (term) JOIN terms USING (term), size GROUP BY ALL),
keyword_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM bm) WHERE rank <= 30)
"""
_FUSED = """
lists AS (SELECT query_id, 0 AS list_no, rank, score, source_id FROM vector_hits UNION ALL SELECT query_id, 1, rank, score, source_id FROM keyword_hits),
fused AS (SELECT query_id, source_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(*) AS n_backends, min(rank) AS best_rank FROM lists GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, n_backends DESC, best_rank, source_id) AS rank FROM fused)
"""


@query("vs1_cosine_topk", "VS1 VS3 SC14 SO9 PJ2", f"WITH {_COSINE} SELECT query_id, source_id, rank, round(score, 4) AS score FROM vector_hits")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("vs4_bm25_topk", "VS4 FL2 SC15", f"WITH {_BM25} SELECT query_id, source_id, rank, round(score, 4) AS score FROM keyword_hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_hits(spark, sf_dir).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def both_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of both searches by id; their payload is joined after fusion, for the rows that stay."""
    hits = vector_hits(spark, sf_dir).select("query_id", F.lit(0).alias("list_no"), F.lit("vector").alias("backend"), "rank", "score", "source_id")
    hits = hits.unionAll(keyword_hits(spark, sf_dir).select("query_id", F.lit(1), F.lit("keyword"), "rank", "score", "source_id"))
    return hits.withColumn("text", F.lit(""))


@query("vs6_hybrid", "VS6 VS7 VS8 VS14 WN1 WN3 SO1 SO2", f"WITH {_COSINE}, {_BM25}, {_FUSED} SELECT query_id, rank, source_id, round(rrf, 6) AS score, n_backends, best_rank FROM ranked WHERE rank <= 10")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: cosine top 30 and BM25 top 30, fused by reciprocal ranks to a top 10, for a batch of queries."""
    out = rk.fuse(both_lists(spark, sf_dir), 60, 10)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "source_id", "score", "n_backends", F.col("best_rank").cast("long").alias("best_rank"))


@query(
    "vs7_nested_rrf", "VS7 VS3",
    f"""WITH {_COSINE}, {_BM25},
    colls AS (SELECT query_id, source_id, source_id::BIGINT % 3 AS c, row_number() OVER (PARTITION BY query_id, source_id::BIGINT % 3 ORDER BY rank) AS rank FROM vector_hits),
    inner_f AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, min(rank), source_id) AS rank FROM colls GROUP BY query_id, source_id),
    lists AS (SELECT query_id, rank, source_id FROM inner_f UNION ALL SELECT query_id, rank, source_id FROM keyword_hits),
    fused AS (SELECT query_id, source_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(*) AS n, min(rank) AS best FROM lists GROUP BY ALL)
    SELECT query_id, source_id, r AS rank, round(rrf, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, n DESC, best, source_id) AS r FROM fused) WHERE r <= 20""",
)
def nested_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three collections are fused first; that list's ranks are then fused with the keyword list."""
    part = F.col("source_id").cast("long") % 3
    rank = F.row_number().over(Window.partitionBy("query_id", part).orderBy("rank"))
    colls = vector_hits(spark, sf_dir).select("query_id", part.cast("int").alias("list_no"), F.concat(F.lit("c"), part).alias("backend"), rank.alias("rank"), "score", "source_id", F.lit("").alias("text"))
    first = rk.fuse_or_pass(colls, 3, top=1000).select("query_id", F.lit(0).alias("list_no"), F.lit("vector").alias("backend"), "rank", "score", "source_id", F.lit("").alias("text"))
    words = keyword_hits(spark, sf_dir).select("query_id", F.lit(1).alias("list_no"), F.lit("keyword").alias("backend"), "rank", "score", "source_id", F.lit("").alias("text"))
    return rk.fuse(first.unionByName(words), 60, 20).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), "score")


_HITS = f"""hits AS (SELECT lang AS query_id, doc_id::VARCHAR AS source_id, {_KIND.replace("'en'", "'zz'")} AS t0, text,
    CASE WHEN source IN ('src1', 'src7') THEN 'law' ELSE 'prec' END AS doc_type,
    round(n_chars / 1000.0::DOUBLE, 3) AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id::VARCHAR) AS rank FROM documents)"""


def language_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked list a language: scores by length, law rows from two sources."""
    d = table(spark, sf_dir, "documents")
    return rk.rank_rows(d.select(
        F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("source_id"), "text",
        F.when(F.col("source").isin("src1", "src7"), "law").otherwise("prec").alias("doc_type"), F.round(F.col("n_chars") / 1000.0, 3).alias("score"),
    ))


@query(
    "wn2_dedup_first", "WN2 VS9 SO8",
    """WITH k AS (SELECT *, sha1(substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 800)) AS key FROM documents)
    SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM (SELECT lang, min(doc_id) AS doc_id FROM k GROUP BY lang, key)""",
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "text", F.lit("").alias("source_id"))
    firsts = d.withColumn("key", rk.plain_text_key()).groupBy("lang", "key").agg(F.min("doc_id").alias("doc_id"))
    return firsts.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("long").alias("rank"))


@query(
    "so8_over_fetch", "SO8 WN2 SO9",
    f"""WITH {_HITS}, few AS (SELECT *, sha1(substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 800)) AS key FROM hits WHERE rank <= 20),
    once AS (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY rank) = 1)
    SELECT query_id, source_id, r AS rank FROM (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS r FROM once) WHERE r <= 10""",
)
def over_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = language_hits(spark, sf_dir).withColumn("id", F.lit(""))
    return rk.over_fetch(hits, 10, 2, rk.plain_text_key("id")).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"))


@query(
    "wn4_policy_select", "WN4 WN17 JN19 FL4",
    f"""WITH {_HITS}, top AS (SELECT * FROM hits WHERE rank <= 5), n AS (SELECT query_id, count(*) FILTER (doc_type = 'law') AS laws, count(*) FILTER (doc_type <> 'law') AS others FROM top GROUP BY ALL),
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS p FROM hits WHERE rank > 5 AND doc_type = 'law'),
    sizes AS (SELECT n.*, (SELECT count(*) FROM pool WHERE pool.query_id = n.query_id) AS pool_n FROM n),
    moves AS (SELECT *, greatest(0, 2 - laws) AS need, least(greatest(0, 2 - laws), pool_n, others) AS moved FROM sizes),
    gone AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS slot FROM top WHERE doc_type <> 'law'),
    kept AS (SELECT t.query_id, t.source_id, t.score, t.doc_type FROM top t LEFT JOIN gone g USING (query_id, source_id) JOIN moves m USING (query_id) WHERE g.slot IS NULL OR g.slot > m.moved
             UNION ALL SELECT p.query_id, p.source_id, p.score, p.doc_type FROM pool p JOIN moves m USING (query_id) WHERE p.p <= m.moved)
    SELECT query_id, source_id, doc_type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank,
           CASE WHEN need = 0 THEN 'ok' WHEN moved >= need THEN 'supplemented' ELSE 'missing' END AS status FROM kept JOIN moves USING (query_id)""",
)
def policy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.select_with_policy(language_hits(spark, sf_dir), 5, 2, True).select("query_id", "source_id", "doc_type", F.col("rank").cast("long").alias("rank"), "status")


@query(
    "wn5_slot_quota", "WN5",
    f"""WITH {_HITS}, laws AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS r FROM hits WHERE doc_type = 'law'),
    quota AS (SELECT query_id, least(greatest(count(*) FILTER (score >= 4), 1), 3, 5) AS quota FROM laws GROUP BY 1)
    SELECT query_id, source_id, 0 AS part, r AS rank FROM laws JOIN quota USING (query_id) WHERE r <= quota
    UNION ALL SELECT query_id, source_id, 1, rank FROM hits LEFT JOIN quota USING (query_id) WHERE rank <= 5 - coalesce(quota, 1)""",
)
def slot_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = language_hits(spark, sf_dir)
    out = rk.slots(rk.rank_rows(hits.where("doc_type = 'law'")), hits, 5, 4.0, 1, 3)
    return out.select("query_id", "source_id", "part", F.col("rank").cast("long").alias("rank"))


@query(
    "vs10_law_boost", "VS10",
    f"""WITH {_HITS}, b AS (SELECT query_id, source_id, doc_type, CASE WHEN query_id IN ('en', 'de') AND doc_type = 'law' THEN score + 0.003 ELSE score END AS score FROM hits)
    SELECT query_id, source_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS r FROM b) WHERE r <= 50""",
)
def law_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = language_hits(spark, sf_dir).withColumn("intent", F.when(F.col("query_id").isin("en", "de"), "normative").otherwise("case_law"))
    return rk.boost_law(hits).where("rank <= 50").select("query_id", "source_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("fl1_or_filter", "FL1 FL2", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND (source IN ('src3', 'src5') OR list_has_any([source, lang], ['src3', 'src9']))")
def or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("lang").alias("doc_type"), F.array("source", "lang").alias("names"))
    names = rt.match_filter(["en", "fr"], ["src3", "src5"], ["source"]) | rt.match_filter(["en", "fr"], ["src3", "src9"], [], ["names"])
    return d.where(names).select("doc_id", "lang", "source")


@query("fl3_noise", "FL3", "SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 200 AND NOT contains(doc_id::VARCHAR, 'supplementary')")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("source_id", F.col("doc_id").cast("string"))
    return rk.drop_noise(d, 200).select("doc_id", "n_chars")


@query(
    "fl4_intents", "FL4 FL5",
    """WITH q AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'normative' WHEN 1 THEN 'case_law' ELSE 'mixed' END AS intent FROM conversations)
    SELECT conv_id, turn, intent, CASE WHEN intent = 'case_law' THEN 'prec,detc,expc,decc' ELSE 'law' END AS use_doc_types, intent = 'normative' AS enforce_law,
           CASE WHEN intent = 'normative' THEN 'law,case' ELSE 'law,case,relation' END AS collections FROM q""",
)
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("conv_id") % 3
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(m == 0, "normative").when(m == 1, "case_law").otherwise("mixed").alias("intent"), F.array(F.lit("law")).alias("doc_types"), F.array(F.lit("x")).alias("law_names"))
    out = rt.intent_filter(q)
    return out.select("conv_id", "turn", "intent", F.array_join("use_doc_types", ",").alias("use_doc_types"), F.col("enforce_law"), F.array_join("collections", ",").alias("collections"))


@query(
    "pj2_hit_rows", "PJ2 PJ3",
    """SELECT doc_id::VARCHAR AS source_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id::VARCHAR) AS rank, substr(replace(text, chr(10), ' '), 1, 180) AS snippet,
              source || ' ' || lang || ' (' || doc_id::VARCHAR || ')' AS citation FROM documents""",
)
def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("source_id"), F.col("n_chars").alias("score"), "text", "source", "lang")
    label = F.concat_ws(" ", rk.blank_to_null(F.col("source")), rk.blank_to_null(F.col("lang")))
    citation = F.when(label != "", F.concat(label, F.lit(" ("), "source_id", F.lit(")"))).otherwise(F.col("source_id"))
    return rt.hit_rows(d).select("source_id", F.col("rank").cast("long").alias("rank"), "snippet", citation.alias("citation"))


@query(
    "vs13_weights", "VS13",
    """SELECT doc_id, round(n_chars::DOUBLE * CASE source WHEN 'src1' THEN 1.2::DOUBLE WHEN 'src2' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE lang WHEN 'de' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 4) AS score FROM documents""",
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("source").alias("collection"), F.col("lang").alias("relation_model"))
    return rt.weigh(d, {"src1": 1.2, "src2": 0.8}, {"de": 0.5}).select("doc_id", F.round("score", 4).alias("score"))


def _type_kind() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(F.lit("en"), F.lit(0), F.lit("fr"), F.lit(1)), "lang"), F.lit(9))


_TYPE_ORDER = """SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 9 END, doc_id) AS place FROM documents"""


@query("so3_type_order", "SO3", _TYPE_ORDER)
@query("so3_type_order_all", "SO3", _TYPE_ORDER)
def type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, ordered within each source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", _type_kind().alias("kind"))
    return rk.places(rows, "source", "kind", "doc_id").select("doc_id", "place")


@query(
    "vs11_context_pack", "VS11 FN5",
    f"""WITH RECURSIVE {_HITS}, t AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE doc_type WHEN 'law' THEN 0 ELSE 2 END, rank) AS r, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM hits WHERE rank <= 50),
    h AS (SELECT *, substr(t, 1, 400) AS head, regexp_extract(substr(t, 1, 400), '(?s)^.*[.!?;:]\\s*', 0) AS said, 400 - strpos(reverse(substr(t, 1, 400)), ' ') AS space FROM t),
    c AS (SELECT query_id, source_id, r, CASE WHEN length(t) <= 400 THEN t ELSE trim(CASE WHEN length(said) >= 220 THEN said WHEN contains(head, ' ') AND space >= 220 THEN substr(head, 1, space) ELSE head END) END AS content FROM h),
    p(query_id, source_id, r, content, used, place, taken) AS (SELECT query_id, source_id, r, content, CASE WHEN length(content) BETWEEN 1 AND 3000 THEN length(content) ELSE 0 END, (length(content) BETWEEN 1 AND 3000)::INT, length(content) BETWEEN 1 AND 3000 FROM c WHERE r = 1
      UNION ALL SELECT c.query_id, c.source_id, c.r, c.content, CASE WHEN length(c.content) > 0 AND p.used + length(c.content) <= 3000 THEN p.used + length(c.content) ELSE p.used END, p.place + (length(c.content) > 0 AND p.used + length(c.content) <= 3000)::INT, length(c.content) > 0 AND p.used + length(c.content) <= 3000
      FROM p JOIN c ON c.query_id = p.query_id AND c.r = p.r + 1)
    SELECT query_id, source_id, place, length(content)::INT AS n_chars, content FROM p WHERE taken""",
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of each language's top 50 under a budget: a row that does not fit is skipped, later ones may fit."""
    return pack_context(language_hits(spark, sf_dir).where("rank <= 50"), 400, 3000)


def _hit_rates(benchmark: DataFrame, documents: DataFrame, wanted: Column) -> DataFrame:
    items = benchmark.select("item_id", F.lower(wanted).alias("head"))
    docs = documents.select("doc_id", "lang", F.lower("text").alias("text"))
    pairs = containing(docs, items, "doc_id", "text", "item_id", "head").join(docs.select("doc_id", "lang"), "doc_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))).where("rank <= 3")
    hits = ranked.groupBy("item_id").agg(F.bool_or(F.col("lang") == "en").alias("hit"))
    all_items = benchmark.join(hits, "item_id", "left").select(F.when(F.col("item_id") % 2 == 0, "normative").otherwise("case_law").alias("intent"), F.coalesce("hit", F.lit(False)).alias("hit"))
    out = all_items.rollup("intent").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))
    return out.select(F.coalesce("intent", F.lit("all")).alias("intent"), "n", "hits", "rate")


_HIT_RATES = """WITH pairs AS (SELECT item_id, doc_id, lang FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM pairs),
    hit AS (SELECT b.item_id, CASE b.item_id % 2 WHEN 0 THEN 'normative' ELSE 'case_law' END AS intent, coalesce(bool_or(rank <= 3 AND lang = 'en'), FALSE) AS hit FROM benchmark b LEFT JOIN ranked r USING (item_id) GROUP BY ALL)
    SELECT coalesce(intent, 'all') AS intent, count(*) AS n, count(*) FILTER (hit) AS hits, round(avg(hit::INT), 6) AS rate FROM hit GROUP BY ROLLUP (intent)"""


@query("ag12_hit_at_k", "AG12 VS15 SK14", _HIT_RATES)
@query("ag12_hit_at_k_all", "AG12 VS15 SK14", _HIT_RATES)
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries; a hit is an English document that holds the item within the first three that do."""
    return _hit_rates(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), F.col("text"))


@query(
    "vs2_named_vectors", "VS2",
    """WITH v AS (SELECT vec_id, 'head' AS name, embedding[1:32] AS e FROM embeddings UNION ALL SELECT vec_id, 'tail', embedding[33:64] FROM embeddings), q AS (SELECT name, e AS qe, vec_id AS qid FROM v WHERE vec_id IN (3, 17)),
    s AS (SELECT q.qid, v.name, v.vec_id, list_cosine_similarity(list_transform(v.e, lambda x: x::DOUBLE), list_transform(q.qe, lambda x: x::DOUBLE)) AS score FROM v JOIN q USING (name))
    SELECT name || '/' || qid::VARCHAR AS query_id, vec_id::VARCHAR AS source_id, row_number() OVER (PARTITION BY name, qid ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM s QUALIFY rank <= 20""",
)
def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with two named vectors; each query asks for one of them by name."""
    e = table(spark, sf_dir, "embeddings")
    out = None
    for name, start in (("head", 1), ("tail", 33)):
        part = e.select(F.col("vec_id").cast("string").alias("source_id"), F.slice("embedding", start, 32).alias("vector"), "vec_id")
        asked = part.where(F.col("vec_id").isin(3, 17)).select(F.concat(F.lit(f"{name}/"), "source_id").alias("query_id"), "vector")
        one = rt.vector_top(part, asked, 20).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "vs5_analyzer", "VS5",
    r"""WITH w AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
    SELECT doc_id, count(*) FILTER (NOT (lang = 'en' AND term IN ('the', 'of', 'and', 'to', 'a')) AND NOT (lang = 'de' AND term IN ('der', 'die', 'und'))) AS terms, count(*) AS standard FROM w GROUP BY doc_id""",
)
def analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an analyzer with a filter of word classes, whose tags are an input by language; without tags it is the standard one."""
    stop = {"en": ("the", "of", "and", "to", "a"), "de": ("der", "die", "und")}
    words = rt.analyzed(F.col("text"), F.col("lang"), stop)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("terms"), F.size(rt.tokens(F.col("text"))).cast("long").alias("standard"))
    return rows.where("standard > 0")


@query(
    "vs12_context_text", "VS12 FN42",
    f"""WITH {_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE doc_type WHEN 'law' THEN 0 WHEN 'prec' THEN 2 ELSE 9 END, rank) AS no FROM hits WHERE rank <= 4),
    b AS (SELECT query_id, string_agg(no::VARCHAR || '. (' || doc_type || ')' || chr(10) || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80), chr(10) || chr(10) ORDER BY no) AS body, count(*) AS n, bool_or(doc_type = 'law') AS law FROM t GROUP BY query_id)
    SELECT query_id, substr(CASE query_id WHEN 'en' THEN 'Answer briefly.' WHEN 'de' THEN 'Answer in depth.' ELSE 'Answer.' END || chr(10) || chr(10) || 'question: what is ' || query_id || chr(10) || 'documents: ' || n::VARCHAR || CASE WHEN law THEN '' ELSE chr(10) || 'note: no law among them' END || chr(10) || chr(10) || body, 1, 300) AS prompt FROM b""",
)
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt of each query: the instruction by level of detail, numbered contexts, laws first, cut to a budget."""
    from tessera.functions.text import squeeze

    hits = language_hits(spark, sf_dir).where("rank <= 4").withColumn("content", F.substring(squeeze(F.col("text")), 1, 80))
    asked = hits.select("query_id").distinct().select("query_id", F.concat(F.lit("what is "), "query_id").alias("question"), F.when(F.col("query_id") == "en", "short").when(F.col("query_id") == "de", "long").alias("detail"))
    return rk.prompts(asked, hits, {"short": "Answer briefly.", "long": "Answer in depth."}, "Answer.", 300)


@query(
    "vs17_keyword_intent", "VS17 VS10",
    f"""WITH {_HITS}, i AS (SELECT query_id, query_id IN ('de', 'fr') AS normative FROM (SELECT DISTINCT query_id FROM hits)), b AS (SELECT query_id, source_id, doc_type, score + CASE WHEN normative AND doc_type = 'law' THEN 0.5 ELSE 0 END AS score FROM hits JOIN i USING (query_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM b), t AS (SELECT * FROM r WHERE rank <= 5)
    SELECT query_id, source_id, rank, count(*) FILTER (doc_type = 'law') OVER (PARTITION BY query_id) >= 2 AS enough FROM t""",
)
def keyword_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent by words of the question, laws raised for normative ones, and whether the top holds enough laws; nothing is put in."""
    said = F.when(F.col("query_id") == "de", "what one must do").when(F.col("query_id") == "fr", "the conditions of it").otherwise("tell me")
    hits = language_hits(spark, sf_dir).withColumn("intent", rk.intent_by_words(said, ("must", "conditions", "shall")))
    return rk.counted_top(rk.boost_law(hits, 0.5), 5, 2).select("query_id", "source_id", F.col("rank").cast("long").alias("rank"), "enough")
