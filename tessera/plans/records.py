"""Records of any shape: nested JSON taken apart, pages of a list read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import nested as ns
from tessera.plans.registry import query, table
from tessera.sources import pages
from tessera.sources.files import scratch_path
from tessera.streaming import events as ev


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its conversation as one nested JSON text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", ns.replies(F.col("turns")).alias("json"))


_THREADS = """WITH t AS (SELECT conv_id, role, text, '$' || coalesce(string_agg(CASE turn % 3 WHEN 1 THEN '.reply[1]' ELSE '.reply' END, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS path FROM conversations)"""


@query(
    "fn19_nested_strings", "FN19",
    rf"""{_THREADS}, s AS (SELECT conv_id, path || '.role[0]' AS path, role AS value FROM t UNION ALL SELECT conv_id, path || '.said[0]', text FROM t)
    SELECT conv_id, path, trim(regexp_replace(value, '\s+', ' ', 'g')) AS value FROM s WHERE trim(regexp_replace(value, '\s+', ' ', 'g')) <> ''""",
)
def nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of every conversation's nested JSON, with its path."""
    return ns.strings(ns.nodes(threads(spark, sf_dir), "conv_id", "json"), "conv_id")


@query("fn48_nested_objects", "FN48 FN28", f"{_THREADS} SELECT conv_id, path, len(string_split(path, '.reply')) - 1 AS turns_above FROM t")
def nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects with a role, whether they stand alone, in a list or in a string."""
    found = ns.objects_with(ns.nodes(threads(spark, sf_dir), "conv_id", "json"), "conv_id", "role")
    return found.select("conv_id", "path", (F.size(F.split("path", r"\.reply")) - 1).cast("long").alias("turns_above"))


PAGE = 500


@query("sc5_paged_stream", "SC5 SC21", f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (ORDER BY o_orderkey) - 1) // {PAGE})::INT AS page FROM orders")
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a list of pages, read as a stream until the short one."""
    top = scratch_path(spark, "pages")
    pages.write_pages(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), f"{top}/list", PAGE, "o_orderkey")
    return ev.run_to_files(pages.stream_pages(spark, f"{top}/list", "o_orderkey long, o_orderstatus string", PAGE), top)


@query("sc5_paged_filter", "SC5 FL6", f"SELECT o_orderkey, o_orderstatus, page FROM (SELECT *, ((row_number() OVER (ORDER BY o_orderkey) - 1) // {PAGE})::INT AS page FROM orders) WHERE page >= 1")
def paged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list from its second page on; the condition reaches the source."""
    top = scratch_path(spark, "pages")
    pages.write_pages(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), top, PAGE, "o_orderkey")
    return pages.read_pages(spark, top, "o_orderkey long, o_orderstatus string", PAGE).where("page >= 1")
