"""Landed response pages as a Spark data source: ``spark.read.format("pages")``.

A page is a file with one JSON object; its number is in its path, and its records are under
the object's first list-valued key. A paging client stops at the first page without records, and so
does this source, while the read is planned: pages are looked at in order, many at
a time, until one has none. Each partition then reads a range of pages.

Options: ``path`` (a folder, searched with all its subfolders; any file system that pyarrow opens),
``pagePattern`` (a regular expression whose first group is the page number, by default the last digits
of the file's path), ``pagesPerPartition`` (64), ``planners`` (pages looked at together while planning, 32).
``recordSchema`` names the records' columns; a value that is not of its column's type is null, and
a list or an object in a text column is its JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLACE = "page bigint, row_in_page int"


def records_of(data: bytes) -> list:
    """The records of a page: the value of the first key that holds a list. A page that is not a JSON object raises."""
    page = json.loads(data)
    if not isinstance(page, dict):
        raise ValueError("a page must be one JSON object")
    return next((v for v in page.values() if isinstance(v, list)), [])


def _typed(value, kind: T.DataType):
    """A JSON value as a value of the column type, or null where it is none."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        bits = {T.LongType: 63, T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}[type(kind)]
        return value if type(value) is int and -(1 << bits) <= value < 1 << bits else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value) if type(value) in (int, float) else None
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return {k: _typed(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, T.StructType):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    raise ValueError(f"pages cannot hold {kind.simpleString()}")


class PageRange(InputPartition):
    def __init__(self, pages: list[tuple[int, str]]):
        self.pages = pages


class PagesReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        if "path" not in options:
            raise ValueError("give the folder of the pages as path")
        self.fields = [f for f in schema.fields if f.name not in ("page", "row_in_page")]
        self.path = options["path"]
        self.pattern = options.get("pagePattern", r"(\d+)\D*$")
        self.size = int(options.get("pagesPerPartition", 64))
        self.planners = int(options.get("planners", 32))

    def _open(self):
        path = re.sub(r"^file:/*", "/", self.path)
        return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)

    def _read(self, files, path: str) -> list:
        with files.open_input_stream(path) as f:
            return records_of(f.read())

    def partitions(self) -> list[PageRange]:
        files, root = self._open()
        found: dict[int, str] = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            hidden = any(part.startswith(("_", ".")) for part in info.path[len(root) :].split("/"))
            number = re.search(self.pattern, info.path)
            if info.is_file and not hidden and number:
                page = int(number[1])
                if page in found:
                    raise ValueError(f"page {page} stands in {found[page]} and in {info.path}")
                found[page] = info.path
        pages = sorted(found.items())
        with ThreadPoolExecutor(self.planners) as pool:
            for at in range(0, len(pages), self.planners):
                some = pages[at : at + self.planners]
                empty = [k for k, held in enumerate(pool.map(lambda p: bool(self._read(files, p[1])), some)) if not held]
                if empty:
                    pages = pages[: at + empty[0]]
                    break
        return [PageRange(pages[k : k + self.size]) for k in range(0, len(pages), self.size)] or [PageRange([])]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        files, _ = self._open()
        for page, path in partition.pages:
            for row, record in enumerate(self._read(files, path)):
                yield (page, row, *(_typed(record.get(f.name) if isinstance(record, dict) else None, f.dataType) for f in self.fields))


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        if "recordSchema" not in self.options:
            raise ValueError("give the records' columns as recordSchema")
        return f"{PLACE}, {self.options['recordSchema']}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagesReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("pages")`` known to the session."""
    spark.dataSource.register(PagesSource)
