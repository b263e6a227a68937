"""Tables that cut lineage, written where every executor can read them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For the time of a write: a shuffle's files end with the query that made them, and Python tasks get
#: rows in small batches, as a row here may be a whole text or thousands of packed hashes.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine, as in tests) gets a
    temporary folder; on a cluster this raises, as executors don't share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="loomspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Written tables of one job.

    ``keep`` writes a table and reads it back, so a lost executor costs a read
    and not the jobs behind it, and lets go of the shuffles behind it. ``drop``
    deletes a table that no later step reads; tables that a returned DataFrame
    still reads go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self._names: set[str] = set()
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column of few values whose rows are written to folders of their own."""
        path = f"{self.root}/{name}"
        self._names.add(name)
        before = {k: self.spark.conf.get(k) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path, partitionBy=by)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        for n in self._names - set(names):
            self.drop(n)

    def drop(self, name: str) -> None:
        self._names.discard(name)
        self._delete(f"{self.root}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session has ended: nothing can be deleted through it
            pass
