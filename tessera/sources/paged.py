"""A paged list source through the Python data source API: one partition a page, an empty or short page is the end.

The service is an input: here a list of rows that stands for it. A remote client would fetch its page in `read`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.size = json.loads(options["rows"]), int(options["pagesize"])
        self.pages = int(options.get("maxpages", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(min(self.pages, -(-len(self.rows) // self.size)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = self.rows[partition.value * self.size : (partition.value + 1) * self.size]
        for key, name in page:
            yield key, name, partition.value


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_paged"

    def schema(self) -> str:
        return "id int, name string, page int"

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, rows: list[tuple[int, str]], size: int, most: int = 1_000_000) -> DataFrame:
    """All pages of the list, up to `most`; rows and pages of one request are few."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("tessera_paged").option("rows", json.dumps(rows)).option("pagesize", size).option("maxpages", most).load()
