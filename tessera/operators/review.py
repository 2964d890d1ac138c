"""History, feedback and review tables: filters, pages, upserts, event logs and clause segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, like: dict[str, str], date: str | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Rows of which any column matches its pattern (case-blind), within whole days; the last day counts."""
    any_of = F.lit(not like)
    for c, pattern in like.items():
        any_of = any_of | F.ilike(F.col(c), F.lit(pattern))
    out = rows.where(any_of)
    if first_day:
        out = out.where(F.col(date) >= F.to_date(F.lit(first_day)))
    if last_day:
        out = out.where(F.col(date) < F.date_add(F.to_date(F.lit(last_day)), 1))
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page and the total number of rows. Both read the filtered rows; only limit + offset rows of each task are sorted."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def after(rows: DataFrame, key: str, cursor: int, limit: int) -> DataFrame:
    """The next rows behind a cursor."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, parents: DataFrame | None = None) -> DataFrame:
    """Old and new rows, the last by `order` of each key; rows without a parent are left out."""
    rest = [c for c in old.columns if c not in keys]
    every = old.unionByName(new)
    out = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return out if parents is None else out.join(parents.distinct(), parents.columns, "left_semi")


def keep_first(new: DataFrame, old: DataFrame, key: str, column: str) -> DataFrame:
    """New rows with the old value of `column` where there is one."""
    return new.withColumnRenamed(column, "_new").join(old, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def numbered(rows: DataFrame, start: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with seq counted on from each key's `top`."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).join(start, key, "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("_n")).drop("_n", "top")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys in `gone`."""
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, child_key), child_key, "left_anti")


def segments(rows: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """clause: how many openings stand up to each row; part: its place within the clause."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("clause", F.sum(F.when(opens, 1).otherwise(0)).over(w).cast("long"))
    return out.withColumn("part", (F.row_number().over(Window.partitionBy(key, "clause").orderBy(order)) - 1).cast("long"))


def keyword_score(rows: DataFrame, key: str, order: str, text: str, rules: list[tuple[str, int, int]]) -> DataFrame:
    """Weights of (keyword, first n paragraphs, weight) summed for each document."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    score = F.lit(0)
    for word, first, weight in rules:
        score = score + F.when((F.col("_p") <= first) & F.contains(text, F.lit(word)), weight).otherwise(0)
    return rows.withColumn("_p", place).groupBy(key).agg(F.sum(score).alias("score"))
