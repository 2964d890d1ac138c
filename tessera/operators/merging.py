"""Joins with resolution rules, ordered merges and snapshot differences.

"First" always has an explicit order; lists that an aggregate collects belong to one key and are meant for keys of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(value: str, *order: Column) -> Column:
    return F.min_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def in_order(value: str | Column, order: str, only: Column | None = None) -> Column:
    """The group's values as a list by the order column; where `only` is false they are left out."""
    item = F.struct(F.col(order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))
    return F.transform(F.array_sort(F.collect_list(item if only is None else F.when(only, item))), lambda x: x.v)


def distinct_in_order(value: str, order: str) -> Column:
    return F.array_distinct(in_order(value, order))


def by_priority(value: str, order: tuple[str, ...]) -> Column:
    """The value that stands first in the order; others come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(value)), F.lit(0)), F.lit(len(order) + 1))
    return F.min_by(value, place)


def mode(rows: DataFrame, key: str, value: str, priority: tuple[str, ...]) -> DataFrame:
    """The most frequent value of each key, ties by priority. Counts are combined before the shuffle."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(value)), F.lit(0)), F.lit(len(priority) + 1))
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -place)).alias(value), F.max("n").alias("n"))


def level_counts(rows: DataFrame, key: str, level: str, levels: tuple[str, ...]) -> DataFrame:
    """n for every key and level, zero where there is none, and each key's worst level; levels go from least to most."""
    place = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    counts = rows.groupBy(key, level).agg(F.count("*").alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(level, "n"))).alias("m"), F.max_by(level, place).alias("worst"))
    every = held.select(key, "worst", "m", F.explode(F.array(*map(F.lit, levels))).alias(level))
    return every.select(key, level, F.coalesce(F.try_element_at("m", level), F.lit(0)).cast("long").alias("n"), "worst")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: a maximum over whole rows, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolve_unique(refs: DataFrame, targets: DataFrame, on: list[str], ref_id: str, target_id: str) -> DataFrame:
    """References with exactly one target. Targets are counted by key before the join, so ambiguous keys never multiply."""
    one = targets.groupBy(*on).agg(F.count("*").alias("_n"), F.min(target_id).alias(target_id)).where("_n = 1").drop("_n")
    return refs.join(one, on)


def resolution_audit(refs: DataFrame, targets: DataFrame, on: list[str], ref_id: str, target_id: str) -> DataFrame:
    """Every reference with the number of its targets, a status and their ids."""
    lists = targets.groupBy(*on).agg(F.array_sort(F.collect_list(target_id)).alias("_t"))
    found = refs.join(lists, on, "left")
    n = F.coalesce(F.size("_t"), F.lit(0))
    n = F.when(F.col("_t").isNull(), 0).otherwise(n).cast("long")
    status = F.when(n == 0, "unresolved_external").when(n == 1, "resolved").otherwise("ambiguous")
    return found.select(ref_id, n.alias("n"), status.alias("status"), F.coalesce(F.array_join(F.transform("_t", lambda x: x.cast("string")), ","), F.lit("")).alias("targets"))


def nest(rows: DataFrame, links: DataFrame, key: str, value: str, name: str, sentinel: str) -> DataFrame:
    """Each row's key with the number and the sorted list of its linked values, the sentinel if it has none."""
    lists = links.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(value)), ",").alias(name))
    return rows.select(key).join(lists, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(name, F.lit(sentinel)).alias(name))


def cascade(rows: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """`found` of the first tier (key column of rows, table of k and found) that has the row's key, and that tier's number."""
    out = rows
    for i, (key, lookup) in enumerate(tiers):
        out = out.join(lookup.select(F.col("k").alias(f"_k{i}"), F.col("found").alias(f"_f{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col(f"_f{i}").isNotNull(), i + 1).otherwise(tier)
    return out.select(*rows.columns, F.coalesce(*[f"_f{i}" for i in range(len(tiers))]).alias("found"), tier.alias("tier"))


def one_per_pair(rows: DataFrame, a: str, b: str, *order: Column) -> DataFrame:
    """One row of each unordered pair."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows to insert, update or delete (op) that lead from old to new; deletes have nulls. Rows are compared null-safe."""
    rest = [c for c in new.columns if c != key]
    o = old.select(F.col(key).alias("_ok"), F.struct(*rest).alias("_o"))
    n = new.select(F.col(key).alias("_nk"), F.struct(*rest).alias("_n"))
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer").where(F.col("_ok").isNull() | F.col("_nk").isNull() | ~F.col("_o").eqNullSafe(F.col("_n")))
    op = F.when(F.col("_ok").isNull(), "insert").when(F.col("_nk").isNull(), "delete").otherwise("update")
    return both.select(F.coalesce("_ok", "_nk").alias(key), op.alias("op"), *[F.col(f"_n.{c}").alias(c) for c in rest])


def apply_patch(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """The table after a patch: rows of the patch replace or add, deletes go."""
    kept = rows.join(patch.select(key).distinct(), key, "left_anti")
    return kept.unionByName(patch.where("op <> 'delete'").drop("op").select(*rows.columns))
