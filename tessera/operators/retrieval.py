"""Exact vector and keyword search for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
#: Queries a batch may hold for its side of a join to be broadcast.
QUERY_LIMIT = 10_000


def few(df: DataFrame, rows: int = QUERY_LIMIT) -> bool:
    """Whether a frame of queries or terms, an input of a batch, has at most `rows` rows; its own plan is run for that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = QUERY_LIMIT) -> DataFrame:
    """The frame, marked for broadcast if it is seen to be small; else left to the planner."""
    return F.broadcast(df) if few(df, rows) else df


#: Rows that one task groups or sorts.
TASK_ROWS = 1 << 21


def dealt(rows: DataFrame, n: int, *keys: str, each: int | None = None) -> DataFrame:
    """The rows by their keys in as many partitions as n rows, `each` to a task, ask for, so that a task's share doesn't grow with the input.
    What groups or joins by these keys, or by more, needs no other shuffle."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // (each or TASK_ROWS))), *keys)


def as_doubles(vector: str) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(vector: Column) -> Column:
    """Length one; a zero or empty vector stays as it is."""
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vector_top(corpus: DataFrame, queries: DataFrame, top: int, id_col: str = "source_id", vector: str = "vector") -> DataFrame:
    """query_id, source_id, score, rank: the `top` rows of highest cosine for each query vector.

    Both sides are brought to length one first, so a pair costs one dot product; each task keeps only its own best rows of a
    query before the shuffle (a rank limit below the window), so what is shuffled is tasks x queries x top.
    """
    c = corpus.select(F.col(id_col).alias("source_id"), normalise(as_doubles(vector)).alias("_c"))
    q = queries.select("query_id", normalise(as_doubles("vector")).alias("_q"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id")

    def best(block: DataFrame) -> DataFrame:
        pairs = c.join(F.broadcast(block), F.lit(True)).select("query_id", "source_id", dot(F.col("_c"), F.col("_q")).alias("score"))
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    if few(queries):
        return best(q)
    # a stated set of queries against all rows, a block of about QUERY_LIMIT queries a pass
    blocks = -(-queries.count() // QUERY_LIMIT) + 1
    out = None
    for k in range(blocks):
        one = best(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k))
        out = one if out is None else out.unionAll(one)
    return out


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def analyzed(text: Column, lang: Column, stop: dict[str, tuple[str, ...]]) -> Column:
    """Tokens without those that the tags of a language stop; languages without tags keep all of them."""
    words = tokens(F.coalesce(text, F.lit("")))
    out = words
    for name, tagged in stop.items():
        out = F.when(lang == name, F.filter(words, lambda w: ~w.isin(*tagged))).otherwise(out)  # noqa: B023
    return out


def keyword_top(corpus: DataFrame, terms: DataFrame, top: int, id_col: str = "source_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, source_id, score, rank by BM25 with an OR of the query's terms (query_id, term).

    One scan makes (id, length, counts of the queries' terms only), so the token table that is shuffled holds rows of
    matching documents, not every word of the corpus.
    """
    wanted = terms.select("query_id", "term").distinct()
    light = few(wanted)
    sent = lambda df: F.broadcast(df) if light else df  # noqa: E731  each frame below has at most the terms' rows
    vocabulary = wanted.select("term").distinct()
    docs = corpus.select(F.col(id_col).alias("source_id"), tokens(F.coalesce(text, F.lit(""))).alias("w"))
    sized = docs.select("source_id", "w", F.size("w").alias("dl"))
    size = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select("source_id", "dl", F.explode("w").alias("term")).join(sent(vocabulary), "term", "left_semi").groupBy("source_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(size)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(sent(idf), "term").join(sent(wanted), "term").groupBy("query_id", "source_id").agg(F.round(F.sum(part), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def holding(docs: DataFrame, items: DataFrame, text: str, wanted: str) -> DataFrame:
    """Pairs of docs and items whose text holds the item's wanted string. A string's longest word that stands between blanks stands
    between blanks in the text too, so rows meet by that word and are then verified; strings of at most two words have no such
    word, and only these are tried against every text."""
    words = F.split(wanted, " ")
    inner = F.when(F.size(words) > 2, F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(1))), lambda w: w != ""))
    keyed = items.withColumn("_inner", inner)
    keyed = keyed.withColumn("_key", F.when(F.size("_inner") > 0, F.expr("array_sort(transform(_inner, w -> struct(-length(w) AS n, w AS w)))[0].w"))).drop("_inner")
    light = few(items, 100_000)
    sent = lambda df: F.broadcast(df) if light else df
    long, short = keyed.where("_key IS NOT NULL"), keyed.where("_key IS NULL").drop("_key")
    keys = long.select("_key").distinct()
    spots = docs.withColumn("_key", F.explode(F.array_distinct(F.split(text, " ")))).join(sent(keys), "_key", "left_semi")
    met = spots.join(sent(long), "_key").where(F.contains(text, wanted)).drop("_key")
    return met.unionByName(docs.join(sent(short), F.contains(text, wanted)))


#: Strings that are searched for in one pass over the texts.
PATTERNS = 100_000


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, wanted: str) -> DataFrame:
    """doc_id, item_id of every text that holds an item's string, whatever it is: all strings of a block are found in one walk through
    each text by an automaton that each task builds. Items are an input of the batch; a block of PATTERNS is on the driver at a time.
    Blank and null strings are in no text."""
    rows = items.where(F.col(wanted) != "").select(item_id, wanted)
    blocks = -(-rows.count() // PATTERNS)
    kinds = {f.name: f.dataType for f in (*docs.schema, *items.schema)}
    schema = T.StructType([T.StructField(doc_id, kinds[doc_id]), T.StructField(item_id, kinds[item_id])])
    out = None
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(item_id, wanted), F.lit(blocks)) == k)
        held: dict[str, list] = {}
        for r in block.collect():
            held.setdefault(r[1], []).append(r[0])
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def find(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for string, ids in shared.value.items():
                automaton.add_word(string, ids)
            automaton.make_automaton()
            for part in parts:
                found = [(d, i) for d, t in zip(part[doc_id], part[text], strict=True) for i in {i for _, ids in automaton.iter(t or "") for i in ids}]
                yield pd.DataFrame(found, columns=[doc_id, item_id])

        one = docs.select(doc_id, text).mapInPandas(find, schema)
        out = one if out is None else out.unionAll(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def match_filter(doc_types: list[str] | None, law_names: list[str] | None, name_columns: list[str], array_columns: list[str] = ()) -> Column:
    """doc_type is one of doc_types, and any of the name columns (or arrays of names) holds one of law_names. Empty lists ask for nothing."""
    out = F.lit(True)
    if doc_types:
        out = out & F.col("doc_type").isin(doc_types)
    if law_names:
        any_name = F.lit(False)
        for c in name_columns:
            any_name = any_name | F.coalesce(F.col(c).isin(law_names), F.lit(False))
        for c in array_columns:
            any_name = any_name | F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, law_names))), F.lit(False))
        out = out & any_name
    return out


def intent_filter(queries: DataFrame) -> DataFrame:
    """Rewrites by intent: case_law drops the law filter and asks for case types, mixed does not enforce law rows; normative
    leaves the relation collection out."""
    case = F.col("intent") == "case_law"
    return queries.select(
        "*",
        F.when(case, F.lit(None).cast("array<string>")).otherwise(F.col("law_names")).alias("use_law_names"),
        F.when(case, F.array(*map(F.lit, ("prec", "detc", "expc", "decc")))).otherwise(F.col("doc_types")).alias("use_doc_types"),
        (~F.col("intent").isin("mixed", "case_law")).alias("enforce_law"),
        F.when(F.col("intent") == "normative", F.array(F.lit("law"), F.lit("case"))).otherwise(F.array(F.lit("law"), F.lit("case"), F.lit("relation"))).alias("collections"),
    )


def hit_rows(rows: DataFrame) -> DataFrame:
    """Backend hits as common rows: ranks from 1, and a snippet of the first 180 characters on one line."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id")
    return rows.select("*", F.row_number().over(order).alias("rank"), F.substring(F.translate(F.coalesce("text", F.lit("")), "\n", " "), 1, 180).alias("snippet"))


def weigh(hits: DataFrame, profile: dict[str, float], models: dict[str, float]) -> DataFrame:
    """score times the collection's multiplier and the relation model's weight; what has none counts 1."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    factor = lambda d, c: F.coalesce(F.try_element_at(pairs(d), F.col(c)), F.lit(1.0)) if d else F.lit(1.0)
    return hits.withColumn("score", F.col("score") * factor(profile, "collection") * factor(models, "relation_model"))
