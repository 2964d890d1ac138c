"""A paged list as a batch and a streaming source: pages lie as files of JSON lines below one path, a short page is the last one.

The batch reader takes filters on `page` and opens no other pages. The stream's offset is the next page to read: it goes on from where
its checkpoint says and ends at the short page. The number of pages follows from the list's total, as services give it with a page
(the file `_total`); where it is missing, pages are opened one after another until the short one. A client of a remote service would
fetch a page where `rows_of` opens a file.

A run over all that is there (trigger availableNow) asks a Python source for its end once, so it must be the list's end; `pagesperbatch`
bounds a batch of triggers that go on, and would end such a run early.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessera.operators.ranking import places

NAME = "tessera_pages"
#: Tasks that read a batch of pages; each takes a run of pages, one at a time.
TASKS = 256
#: The pages that a filter on `page` leaves: from the first, up to but without the second.
_LEFT = {
    EqualTo: lambda v: (v, v + 1),
    GreaterThan: lambda v: (v + 1, None),
    GreaterThanOrEqual: lambda v: (v, None),
    LessThan: lambda v: (0, v),
    LessThanOrEqual: lambda v: (0, v + 1),
}


def write_pages(rows: DataFrame, path: str, size: int, key: str) -> None:
    """The rows in the order of `key` (distinct whole numbers) as pages of `size`. No task numbers all rows."""
    numbered = places(rows.withColumns({"_all": F.lit(0), "_kind": F.lit(0)}), "_all", "_kind", key)
    page = F.floor((F.col("place") - 1) / size).cast("int")
    paged = numbered.select(*rows.columns, page.alias("page"))
    # tasks commit their own pages: the driver would move them one by one
    paged.repartition("page").sortWithinPartitions("page", key).write.partitionBy("page").option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)
    rows.agg(F.count("*").alias("total")).coalesce(1).write.json(f"{path}/_total")


def total_of(path: str) -> int | None:
    """The number of rows of the list; None if it does not say."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(f"{path}/_total")
    for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".json") and info.size:
            with system.open_input_stream(info.path) as f:
                return json.loads(f.read())["total"]
    return None


def rows_of(path: str, page: int) -> list[dict] | None:
    """The rows of a page in order; None if there is no such page."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(f"{path}/page={page}")
    if system.get_file_info(top).type != fs.FileType.Directory:
        return None
    out: list[dict] = []
    for info in sorted(system.get_file_info(fs.FileSelector(top)), key=lambda i: i.path):
        if info.is_file and info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                out += [json.loads(line) for line in f.read().decode().splitlines()]
    return out


class Pages(InputPartition):
    """A run of pages, up to but without `end`."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Pages:
    def __init__(self, schema: object, options: dict):
        self.fields = [f.name for f in schema.fields if f.name != "page"]
        self.path, self.size = options["path"], int(options["pagesize"])
        self.most = int(options["pagesperbatch"]) if "pagesperbatch" in options else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(partition.first, partition.end):
            for row in rows_of(self.path, page) or ():
                yield (*(row.get(f) for f in self.fields), page)

    def end_from(self, page: int, end: int | None = None) -> int:
        """The page behind the last one, if that is before `end`."""
        if (total := total_of(self.path)) is not None:
            last = -(-total // self.size)
            return max(page, last if end is None else min(last, end))
        while end is None or page < end:
            rows = rows_of(self.path, page)
            if rows is None:
                break
            page += 1
            if len(rows) < self.size:
                break
        return page

    def runs(self, first: int, end: int) -> list[InputPartition]:
        n = min(TASKS, end - first)
        return [Pages(first + (end - first) * k // n, first + (end - first) * (k + 1) // n) for k in range(n)]


class PageReader(_Pages, DataSourceReader):
    first, end = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _LEFT and f.attribute == ("page",):
                first, end = _LEFT[type(f)](f.value)
                self.first = max(self.first, first)
                self.end = end if self.end is None else self.end if end is None else min(self.end, end)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.runs(self.first, self.end_from(self.first, self.end)) or [Pages(0, 0)]  # no such page


class PageStream(_Pages, DataSourceStreamReader):
    seen = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": self.end_from(self.seen, None if self.most is None else self.seen + self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["page"])
        return self.runs(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["page"])


class PageSource(DataSource):
    """Options path, pagesize and, for streams, pagesperbatch; the schema is the user's, with `page` as its last column."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: object) -> DataSourceReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return PageStream(schema, self.options)


def _reader(spark: SparkSession, reader: object, path: str, schema: str, size: int) -> object:
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    return reader.format(NAME).schema(f"{schema}, page int").option("path", path).option("pagesize", size)


def read_pages(spark: SparkSession, path: str, schema: str, size: int) -> DataFrame:
    """All pages; conditions on `page` open only those that can fulfil them."""
    return _reader(spark, spark.read, path, schema, size).load()


def stream_pages(spark: SparkSession, path: str, schema: str, size: int, per_batch: int | None = None) -> DataFrame:
    """Pages as a stream; at most `per_batch` a batch, if given (for triggers that go on)."""
    reader = _reader(spark, spark.readStream, path, schema, size)
    return (reader if per_batch is None else reader.option("pagesperbatch", per_batch)).load()
