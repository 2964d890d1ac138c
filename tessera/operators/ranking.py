"""Ranking, fusion and selection of search hits. Every operator works on a batch of queries at once: rows carry
query_id, and all grouping and windows are by it.

A hit has query_id, source_id, rank, score, doc_type, text (other columns are carried along).
Blank and null strings count as the same; a null score is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOST = 0.003
LAW = "law"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def places(rows: DataFrame, group: str, kind: str, key: str, width: int = 4096) -> DataFrame:
    """Rows with their place in the group by (kind, key). key: whole numbers, distinct in a group; no task holds a whole group: rows are numbered
    in ranges of `width` keys, and the ranges' counts are summed up."""
    cut = rows.withColumn("_b", F.floor(F.col(key) / width))
    parts = [F.col(c) for c in (group, kind, "_b")]
    counts = cut.groupBy(F.col(group).alias("_g"), F.col(kind).alias("_k"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_k", "_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_g", "_k", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*parts).orderBy(key)))
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col(kind).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c"))
    return numbered.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_r")).cast("long").alias("place"))


def raw_text_key(source_id: str = "source_id", text: str = "text") -> Column:
    """The id, or a digest of the first 800 characters as they are (fusion's notion of one document)."""
    return F.coalesce(F.when(F.col(source_id) != "", F.col(source_id)), F.concat(F.lit("text::"), F.sha1(F.substring(F.coalesce(text, F.lit("")), 1, 800))))


def plain_text_key(source_id: str = "source_id", text: str = "text") -> Column:
    """The id, or a digest of 800 characters of squeezed lower-case text (deduplication's notion)."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))
    return F.coalesce(F.when(F.col(source_id) != "", F.col(source_id)), F.sha1(F.substring(plain, 1, 800)))


def by_score(*group: str) -> Window:
    return Window.partitionBy(*group).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.coalesce("source_id", F.lit("")))


def rank_rows(hits: DataFrame, group: str = "query_id") -> DataFrame:
    """Dense ranks from 1 by score, then id."""
    return hits.withColumn("rank", F.row_number().over(by_score(group)))


def first_by_key(hits: DataFrame, key: Column, *group: str) -> DataFrame:
    """The best-ranked row of each key; rows of rank 0 and below are dropped."""
    order = Window.partitionBy(*group, "_key").orderBy("rank", "source_id")
    return hits.where("rank > 0").withColumn("_key", key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_key")


def drop_noise(hits: DataFrame, min_chars: int) -> DataFrame:
    """Rows whose trimmed text is long enough and which are no supplementary part."""
    return hits.where((F.length(F.trim(F.coalesce("text", F.lit("")))) >= min_chars) & ~F.coalesce(F.col("source_id").contains("supplementary"), F.lit(False)))


def fuse(hits: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of the lists in `backend`, ordered by `list_no`. The payload is that of the first list
    a document stands in; ties go to more backends, then the better rank, then the id. Scores are rounded to 6 places."""
    rows = hits.where("rank > 0").withColumn("_key", raw_text_key())
    best = rows.groupBy("query_id", "list_no", "backend", "_key").agg(F.min_by(F.struct(*hits.columns), F.struct("rank", "source_id")).alias("h"))
    best = best.select("query_id", "list_no", "backend", "_key", F.col("h.rank").alias("rank"), "h")
    fused = best.groupBy("query_id", "_key").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.count_distinct(F.when(F.col("backend") != "", F.col("backend"))).alias("n_backends"),
        F.min("rank").alias("best_rank"),
        F.min_by("h", "list_no").alias("h"),
        F.max(F.when(F.col("h.source_id") != "", F.col("h.source_id"))).alias("source_id"),
        F.array_sort(F.collect_list(F.struct("list_no", "backend", "rank", F.col("h.score").alias("score")))).alias("sources"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("n_backends"), "best_rank", F.coalesce("source_id", F.lit("")))
    ranked = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    carried = [F.col(f"h.{c}").alias(c) for c in hits.columns if c not in ("query_id", "list_no", "backend", "rank", "score", "source_id")]
    return ranked.select("query_id", "rank", F.round("rrf", 6).alias("score"), F.coalesce("source_id", F.lit("")).alias("source_id"), "n_backends", "best_rank", "sources", *carried)


def fuse_or_pass(hits: DataFrame, lists: int, k: int = 60, top: int = 10) -> DataFrame:
    """Fusion of several lists; a single list goes through untouched and is not cut."""
    return hits if lists == 1 else fuse(hits, k, top)


def boost_law(hits: DataFrame, boost: float = BOOST) -> DataFrame:
    """Law rows of normative queries (column intent) gain a little; those queries are ranked again."""
    normative = F.col("intent") == "normative"
    score = F.coalesce("score", F.lit(0.0)) + F.when(F.col("doc_type") == LAW, boost).otherwise(0.0)
    raised = hits.withColumn("score", F.when(normative, score).otherwise(F.col("score")))
    return raised.withColumn("rank", F.when(normative, F.row_number().over(by_score("query_id"))).otherwise(F.col("rank")))


def select_with_policy(hits: DataFrame, top: int, min_law: int, enforce: bool) -> DataFrame:
    """The top rows of each query, with at least min_law law rows if asked: the lowest non-law rows give way to the best law
    rows from outside. status: ok, missing, supplemented or case_only; added tells if the minimum is met."""
    top = max(1, top)
    q = Window.partitionBy("query_id")
    rows = hits.withColumn("_pos", F.row_number().over(q.orderBy("rank", "source_id")))
    law = F.col("doc_type") == LAW
    inside = F.col("_pos") <= top
    rows = rows.withColumns({"_law_in": F.sum(F.when(inside & law, 1).otherwise(0)).over(q), "_n_in": F.sum(F.when(inside, 1).otherwise(0)).over(q)})
    seen = F.max(F.when(inside, 1).otherwise(0)).over(Window.partitionBy("query_id", "source_id"))
    rows = rows.withColumn("_pool", ~inside & law & ((F.coalesce("source_id", F.lit("")) == "") | (seen == 0)))
    rows = rows.withColumn("_pool_no", F.when(F.col("_pool"), F.row_number().over(Window.partitionBy("query_id", "_pool").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "source_id"))))
    rows = rows.withColumn("_slot", F.when(inside & ~law, F.row_number().over(Window.partitionBy("query_id", (inside & ~law)).orderBy(F.desc("_pos")))))
    rows = rows.withColumns({"_n_pool": F.sum(F.col("_pool").cast("int")).over(q), "_n_slot": F.sum(F.when(F.col("_slot").isNotNull(), 1).otherwise(0)).over(q)})
    need = F.greatest(F.lit(min_law) - F.col("_law_in"), F.lit(0))
    moves = F.least(need, F.col("_n_pool"), F.col("_n_slot")) if enforce else F.lit(0)
    rows = rows.withColumns({"_need": need, "_moves": moves})
    kept = rows.where((inside & (F.col("_slot").isNull() | (F.col("_slot") > F.col("_moves")))) | (F.col("_pool_no") <= F.col("_moves")))
    status = F.when(F.col("_need") == 0, "ok")
    status = status.when(F.col("_moves") >= F.col("_need"), "supplemented") if enforce else status.when(F.col("_law_in") == 0, "case_only")
    kept = kept.withColumn("status", status.otherwise("missing")).withColumn("added", F.col("status").isin("ok", "supplemented"))
    return rank_rows(kept.drop("_pos", "_law_in", "_n_in", "_pool", "_pool_no", "_slot", "_n_pool", "_n_slot", "_need", "_moves"))


def slots(laws: DataFrame, cases: DataFrame, top: int, threshold: float, low: int, high: int) -> DataFrame:
    """Law rows get a quota, the number at or above the threshold within low..high; the rest are the first cases. Slots that
    laws leave empty stay empty, and a row can stand in both parts."""
    quota = laws.groupBy("query_id").agg(F.count_if(F.coalesce("score", F.lit(0.0)) >= threshold).alias("strong"))
    quota = quota.select("query_id", F.least(F.greatest("strong", F.lit(low)), F.lit(high), F.lit(top)).alias("quota"))
    first = laws.join(quota, "query_id").where("rank <= quota").select(*laws.columns, F.lit(0).alias("part"))
    rest = cases.join(quota, "query_id", "left").where(F.col("rank") <= F.lit(top) - F.coalesce("quota", F.lit(min(low, top)))).select(*laws.columns, F.lit(1).alias("part"))
    both = first.unionByName(rest)
    return both.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "source_id")))


def over_fetch(hits: DataFrame, top: int, multiple: int, key: Column) -> DataFrame:
    """Only top * multiple rows are looked at, then repeats go, then the first `top` stay: there can be fewer."""
    few = rank_rows(hits).where(F.col("rank") <= top * multiple)
    return rank_rows(first_by_key(few, key, "query_id")).where(F.col("rank") <= top)


#: Order of document types in a context; others come last.
TYPE_ORDER = {"law": 0, "expc": 1, "prec": 2, "decc": 3, "detc": 4}


def prompts(queries: DataFrame, contexts: DataFrame, details: dict[str, str], usual: str, budget: int) -> DataFrame:
    """query_id, prompt: the instruction by level of detail, the question, and the numbered contexts (query_id, doc_type, content, rank;
    a few rows a query) with laws first; a note where there is no law; cut to the budget of characters."""
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), "doc_type"), F.lit(9))
    rows = contexts.withColumn("_no", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "rank")))
    line = F.concat(F.col("_no").cast("string"), F.lit(". ("), F.coalesce("doc_type", F.lit("")), F.lit(")\n"), "content")
    body = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", line.alias("line")))), lambda x: x.line), "\n\n").alias("_body"), F.count("*").alias("_n"), F.bool_or(F.col("doc_type") == LAW).alias("_law"))
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in details.items() for x in kv]), "detail"), F.lit(usual))
    out = queries.join(body, "query_id", "left")
    note = F.when(F.coalesce("_law", F.lit(False)), "").otherwise("\nnote: no law among them")
    text = F.concat(said, F.lit("\n\nquestion: "), "question", F.lit("\ndocuments: "), F.coalesce("_n", F.lit(0)).cast("string"), note, F.lit("\n\n"), F.coalesce("_body", F.lit("(none)")))
    return out.select("query_id", F.substring(text, 1, budget).alias("prompt"))


def intent_by_words(question: Column, words: tuple[str, ...]) -> Column:
    """normative if the question holds any of the words, else case_law."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.coalesce(question, F.lit("")), F.lit(w))
    return F.when(hit, "normative").otherwise("case_law")


def counted_top(hits: DataFrame, top: int, min_law: int) -> DataFrame:
    """The first rows of each query, with whether they hold enough laws."""
    rows = hits.where(F.col("rank") <= max(1, top))
    return rows.withColumn("enough", F.count_if(F.col("doc_type") == LAW).over(Window.partitionBy("query_id")) >= min_law)
