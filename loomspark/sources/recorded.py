"""A source of recorded metadata, as a Spark data source: what a site once said of its pages, read as a table.

A recording is a folder of files of JSON lines, ``{"url": ..., "info": {...}}``, or
``{"url": ..., "body": ...}`` for caption tracks. A file is a partition. Conditions on the
url are taken into the reader where Spark offers them
(``spark.sql.python.filterPushdown.enabled``): lines of other pages are then not parsed.

The folder may be in any store that pyarrow opens by its address; a path without
a scheme is local, and must be one that all executors share.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

FORMAT = "recorded"
#: Lines that are handed to Spark at a time.
BATCH = 2000


class RecordedFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    address = path if "://" in path else path.replace("file:", "", 1)
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


class RecordedReader(DataSourceReader):
    def __init__(self, path: str, field: str) -> None:
        self.path, self.field = path, field
        self.urls: set[str] | None = None

    def partitions(self) -> list[RecordedFile]:
        store, root = _opened(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [RecordedFile(f.path) for f in files if f.type == fs.FileType.File and f.base_name.endswith((".json", ".jsonl")) and not f.base_name.startswith(("_", "."))]

    def read(self, partition: RecordedFile) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        # A line that may be of a wanted page holds its url as JSON writes it.
        wanted = None if self.urls is None else [json.dumps(u)[1:-1].encode() for u in self.urls] + [json.dumps(u, ensure_ascii=False)[1:-1].encode() for u in self.urls]
        rows: list[tuple[str, str | None]] = []
        with store.open_input_stream(partition.path) as raw, io.BufferedReader(raw) as lines:
            for line in lines:
                if wanted is not None and not any(u in line for u in wanted):
                    continue
                try:
                    said = json.loads(line)
                except ValueError:  # a torn line is no record
                    continue
                if not isinstance(said, dict) or not isinstance(said.get("url"), str) or (self.urls is not None and said["url"] not in self.urls):
                    continue
                value = said.get(self.field)
                rows.append((said["url"], value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple[str, str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["url", self.field])


class PrunedReader(RecordedReader):
    """Takes conditions on the url; Spark has such a reader only where it offers them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("url",):
                self._only(set(f.value))
            else:
                yield f  # Spark sees to it

    def _only(self, urls: set[str]) -> None:
        self.urls = urls if self.urls is None else self.urls & urls


class RecordedSource(DataSource):
    """``path``: the folder; ``field``: ``info`` or ``body``, the second column; ``prune``: whether the session pushes filters down."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _field(self) -> str:
        field = self.options.get("field", "info")
        if field not in ("info", "body"):
            raise ValueError("field is info or body")
        return field

    def schema(self) -> str:
        return f"url string, {self._field()} string"

    def reader(self, schema: StructType) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("path is missing")
        kind = PrunedReader if self.options.get("prune") == "true" else RecordedReader
        return kind(self.options["path"], self._field())


def recorded(spark: SparkSession, path: str, field: str = "info") -> DataFrame:
    """(url, info) or (url, body) of a recording, as JSON text; torn lines and such without a url are skipped."""
    spark.dataSource.register(RecordedSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).option("field", field).option("prune", prune).load(path)


def record(rows: DataFrame, path: str) -> None:
    """Writes (url, info or body) as a recording."""
    rows.write.mode("overwrite").json(path)


def probe(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """(url, info, error) for each asked url; of several records the least counts, and a page without one says so."""
    one = recorded(spark, path).groupBy("url").agg(F.min("info").alias("info"))
    asked = urls.select("url").distinct().join(one, "url", "left")
    return asked.select("url", "info", F.when(F.col("info").isNull(), F.concat(F.lit("nothing recorded for "), "url")).alias("error"))
