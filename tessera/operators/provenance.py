"""Merges that keep where a row comes from, prefix and alias joins, and nodes and edges built from relation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import filled
from tessera.operators.retrieval import dealt


def merge_sources(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each key of any source once, with the sorted list of the sources that hold it: a full outer merge as one aggregate, so a
    hot key is combined before the shuffle."""
    every = None
    for name, rows in sources.items():
        one = rows.select(*keys, F.lit(name).alias("_s"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_s")), ",").alias("provenance"))


def prefix_pairs(names: DataFrame, column: str) -> DataFrame:
    """short, long: distinct names of which one begins the other. The longer name's own beginnings are joined by equality, so no
    pair of unrelated names is looked at; a name has at most its length of them."""
    once = names.select(F.col(column).alias("long")).where(filled(F.col(column)).isNotNull()).distinct()
    starts = once.select("long", F.explode(F.transform(F.sequence(F.lit(1), F.length("long")), lambda n: F.substring(F.col("long"), F.lit(1), n))).alias("short"))
    return starts.where("short <> long").join(once.withColumnRenamed("long", "short"), "short", "left_semi").select("short", "long")


def first_filled_by(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row a key: of each column the first filled value by the order."""
    firsts = [F.min_by(F.when(filled(F.col(c)).isNotNull(), F.col(c)), F.when(filled(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*firsts)


def both_ends(relations: DataFrame, source: list[str], target: list[str], names: list[str]) -> DataFrame:
    """Node rows of both ends of each relation, under the same names; end: 0 for sources, 1 for targets."""
    pick = lambda columns, end: relations.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.lit(end).alias("end"))
    return pick(source, 0).unionByName(pick(target, 1))


def reference_edges(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """refs (src, law, article, confidence) to edges (src, dst, kind, mentions, confidence): to the article where it is a known
    node; to the law only if no reference of the pair led to an article. Loops go."""
    known = articles.select("law", "article", F.lit(True).alias("_known")).distinct()
    rows = refs.join(known, ["law", "article"], "left").where(F.col("src") != F.col("law"))
    counted = rows.groupBy("src", "law", F.when(F.col("_known"), F.col("article")).alias("article")).agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"))
    found = counted.where("article IS NOT NULL").select("src", "law").distinct()
    to_article = counted.where("article IS NOT NULL").select("src", F.concat_ws("::", "law", "article").alias("dst"), F.lit("REFERS_TO_ARTICLE").alias("kind"), "mentions", "confidence")
    to_law = counted.where("article IS NULL").join(found, ["src", "law"], "left_anti").select("src", F.col("law").cast("string").alias("dst"), F.lit("REFERS_TO_LAW").alias("kind"), "mentions", "confidence")
    return to_article.unionAll(to_law)


#: Edge kinds of relation rows by model, and of cases by the way they are cited.
CASE_EDGES = {"law_to_case": "INTERPRETED_BY", "article_to_case": "APPLIED_IN", "case_to_case": "CITES", "case_to_law": "CONSTRUES", "case_to_article": "CONSTRUES_ARTICLE"}


def case_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations (model, source, target) to edges of five kinds; both ends must be known nodes (id)."""
    kinds = F.create_map(*[F.lit(x) for kv in CASE_EDGES.items() for x in kv])
    ids = nodes.select("id").distinct()
    rows = relations.withColumn("kind", F.try_element_at(kinds, F.col("model"))).where("kind IS NOT NULL")
    rows = rows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return rows.where("source <> target").groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


def upsert_edges(edges: DataFrame, keys: list[str], lists: list[str], confidence: str) -> DataFrame:
    """One edge a key: the sorted union of its lists, the greatest confidence. Values are made distinct before lists are built."""
    out = edges.groupBy(*keys).agg(F.max(confidence).alias(confidence))
    for c in lists:
        values = edges.select(*keys, F.explode(c).alias("_v")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(c))
        out = out.join(values, keys, "left")
    return out


def best_match(candidates: DataFrame, group: str, name: Column, wanted: Column, order: str) -> DataFrame:
    """One candidate a group: an equal name, else one that holds the wanted name, else the first; ties by the order."""
    tight = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    tier = F.when(tight(name) == tight(wanted), 0).when(F.contains(tight(name), tight(wanted)), 1).otherwise(2)
    rest = [c for c in candidates.columns if c != group]
    rows = dealt(candidates, candidates.count(), group).withColumn("tier", tier)
    return rows.groupBy(group).agg(F.min_by(F.struct(*rest, "tier"), F.struct("tier", order)).alias("_r")).select(group, *[F.col(f"_r.{c}").alias(c) for c in (*rest, "tier")])


def known_names(raw: Column, aliases: dict[str, str], known: tuple[str, ...]) -> Column:
    """Names by alias, only those in the dictionary, each once in order of first place."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    named = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.coalesce(F.try_element_at(table, F.trim(x)), F.trim(x)))
    return F.array_distinct(F.filter(named, lambda x: F.array_contains(F.array(*map(F.lit, known)), x)))


def allowed_or_default(raw: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed values of a list, trimmed, each once in order; all that are allowed if none is left."""
    every = F.array(*map(F.lit, allowed))
    kept = F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.array_contains(every, x)))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def relation_rows(models: dict[str, DataFrame], barred: tuple[str, ...]) -> DataFrame:
    """The rows (id, source, ...) of all relation models with their model; case_to_case rows of barred source kinds go."""
    every = None
    for name, rows in models.items():
        one = rows.withColumn("model", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every.where((F.col("model") != "case_to_case") | ~F.col("source").isin(*barred))
