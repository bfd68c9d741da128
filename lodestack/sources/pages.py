"""A source of numbered pages as Spark's own: read as a table, or as a stream that goes on where the last run committed.

A page is a JSON document, {"items": [...]} or a list, in files of a folder whose path tells its number: page-12.json, or any file
under page=12. What can't be parsed is a row as well, with `bad` true: a page that isn't JSON is one such row, at position -1."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, position int, record string, bad boolean"
_ARROW = pa.schema([("page", pa.int64()), ("position", pa.int32()), ("record", pa.string()), ("bad", pa.bool_())])
_NUMBER = re.compile(r"page[=-](\d+)(?:/[^/]*|\.json)$")
#: Rows that a task hands on at a time, and pages of a task.
ROWS, PAGES = 2000, 16


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


def _store(path: str):
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[int, str]]:
    """(number, file) of all pages, in order; files with a leading dot or underscore are no pages."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    named = ((_NUMBER.search(f.path), f.path) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return sorted((int(n[1]), p) for n, p in named if n)


def _items(text: str) -> Iterator[tuple[int, str, bool]]:
    """(position, record, bad) of the items of a page; an item that is no object, or has no id, is bad."""
    try:
        page = json.loads(text)
    except ValueError:
        page = None
    items = page.get("items") if isinstance(page, dict) else page
    if not isinstance(items, list):
        yield -1, text, True
        return
    for k, item in enumerate(items):
        yield k, json.dumps(item, ensure_ascii=False), not (isinstance(item, dict) and item.get("id") not in (None, ""))


class _Pages:
    """What reader and stream share: tasks of a few pages each, that read one page at a time."""

    def __init__(self, options: dict[str, str]):
        self.path, self.each = options["path"], int(options.get("pagesPerTask", PAGES))

    def _tasks(self, files: list[tuple[int, str]]) -> list[Files]:
        return [Files(files[k : k + self.each]) for k in range(0, len(files), self.each)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, rows = _store(self.path)[0], []
        for number, file in partition.files:
            with store.open_input_stream(file) as f:
                text = f.read().decode("utf-8", "replace")
            for item in _items(text):
                rows.append((number, *item))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._tasks(_listed(self.path)) or [Files([])]


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets are page numbers: a trigger takes the pages after the last one committed. A page is complete when its file is there, and
    pages come in the order of their numbers."""

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max((n for n, _ in _listed(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self._tasks([x for x in _listed(self.path) if start["page"] < x[0] <= end["page"]]) or [Files([])]

    def commit(self, end: dict) -> None:
        """Pages stay where they are; Spark's checkpoint holds the offset."""


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def read(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """(page, position, record, bad) of a folder of pages."""
    spark.dataSource.register(Pages)
    return (spark.readStream if stream else spark.read).format("pages").options(**options).load(path)


def accounts(records: DataFrame) -> DataFrame:
    """(page, declared, parsed, dropped): declared = parsed + dropped, on every page."""
    return records.groupBy("page").agg(F.count("*").alias("declared"), F.count_if(~F.col("bad")).alias("parsed"), F.count_if("bad").alias("dropped"))


def drain(spark: SparkSession, path: str, into: str, checkpoint: str, **options) -> None:
    """All pages that no earlier run with this checkpoint has taken, appended to `into`; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/batch={number}")

    flow = read(spark, path, stream=True, **options).writeStream.foreachBatch(write)
    flow.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
