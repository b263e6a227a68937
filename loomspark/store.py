"""Tables that outlive a query: where they go, and what their source looked like."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="loomspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session on one machine without it gets a temporary folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@dataclass(frozen=True)
class Files:
    """The few file operations that DataFrames don't have, by Hadoop's own interface: any store that Spark reads will do."""

    spark: SparkSession

    def _at(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return bool(fs.exists(p))

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> bool:
        p, fs = self._at(path)
        return bool(fs.rename(p, self._at(to)[0]))

    def state(self, path: str) -> str:
        """Changes when files are added, replaced or removed: a digest of the path, its size, files and time of change."""
        p, fs = self._at(path)
        summary, status = fs.getContentSummary(p), fs.getFileStatus(p)
        said = f"{status.getPath()} {summary.getLength()} {summary.getFileCount()} {status.getModificationTime()}"
        return hashlib.sha256(said.encode()).hexdigest()[:24]

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return int(fs.getContentSummary(p).getLength())


def derived(spark: SparkSession, source: str, name: str) -> str:
    """Where something made from a stored table lies, as that table is now: a changed table leads to another place."""
    return f"{shared_dir(spark)}/derived/{Files(spark).state(source)}/{name}"


@contextmanager
def complete(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write to that becomes ``path`` when all of it is written, and not before."""
    files, aside = Files(spark), f"{path}.{uuid.uuid4().hex}"
    try:
        yield aside
    except BaseException:
        files.delete(aside)
        raise
    if files.exists(path) or not files.rename(aside, path):  # another session was sooner: what it wrote is as good
        files.delete(aside)
