"""Nested JSON of any depth as rows: VARIANT values taken apart level by level in a recursive query.

Nothing about the shape is assumed: at every level there may be an object, a list or a single value, levels may be missing, and a string
that itself holds an object or a list is opened too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels the recursion may have; a deeper value fails the query instead of losing rows.
LEVELS = 200


def opened(v: str) -> str:
    """SQL: the variant; if it is a string that holds an object or a list, that one."""
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN coalesce(CASE WHEN {v}::string RLIKE '^\\\\s*[\\\\x7B\\\\[]' THEN try_parse_json({v}::string) END, {v}) ELSE {v} END"


def nodes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, parent, name, depth, kind, value: every node of each row's JSON text. `name` is the member's name, null for list elements
    and the top; `value` is the text of a string, number or truth value. A text that is no JSON, or null, has no nodes."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", LEVELS)
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    base = rows.select(F.col(key).alias("key"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    step = "CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END"
    tree = spark.sql(
        f"""WITH RECURSIVE tree(key, path, parent, name, depth, v) AS (
            SELECT key, '$', CAST(NULL AS STRING), CAST(NULL AS STRING), 0, {opened("v")} FROM {{base}}
            UNION ALL
            SELECT t.key, concat(t.path, {step}), t.path, e.key, t.depth + 1, {opened("e.value")} FROM tree t, LATERAL variant_explode(t.v) e)
        SELECT * FROM tree""",
        base=base,
    )
    kind = F.expr("CASE WHEN is_variant_null(v) THEN 'null' ELSE lower(substring_index(schema_of_variant(v), '<', 1)) END")
    scalar = F.when(~kind.isin("object", "array", "null"), F.col("v").cast("string"))
    return tree.select(F.col("key").alias(key), "path", "parent", "name", "depth", kind.alias("kind"), scalar.alias("value"))


def strings(tree: DataFrame, key: str) -> DataFrame:
    """key, path, value: squeezed strings that are not blank."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return tree.where("kind = 'string'").select(key, "path", text.alias("value")).where("value <> ''")


def objects_with(tree: DataFrame, key: str, name: str) -> DataFrame:
    """key, path: the objects, at whatever depth, that have a member of this name. A list or a single object below a name is the same."""
    return tree.where(F.col("name") == name).select(key, F.col("parent").alias("path")).distinct()


def member(tree: DataFrame, key: str, name: str) -> DataFrame:
    """key, path, value: of each object the scalar member of this name."""
    return tree.where((F.col("name") == name) & F.col("value").isNotNull()).select(key, F.col("parent").alias("path"), "value")


def replies(turns: Column) -> Column:
    """A conversation as one object of as many levels as it has turns: each turn holds its answer as a single object, a list, or a
    string of JSON, by turns."""
    one = lambda t, inner: F.concat(F.lit('{"role":'), F.to_json(F.array(t.role)), F.lit(',"said":'), F.to_json(F.array(t.text)), inner, F.lit("}"))

    def around(acc: Column, t: Column) -> Column:
        inner = F.when(acc == "", "").when(t.turn % 3 == 0, F.concat(F.lit(',"reply":'), acc)).when(t.turn % 3 == 1, F.concat(F.lit(',"reply":[null,'), acc, F.lit("]")))
        text = F.to_json(F.array(acc))
        return one(t, inner.otherwise(F.concat(F.lit(',"reply":'), F.substring(text, 2, F.length(text) - 2))))

    return F.aggregate(F.reverse(turns), F.lit(""), around)
