"""Streaming forms of the clock-driven counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files as they arrive, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def daily_budget(events: DataFrame, late: str = "1 day") -> DataFrame:
    """What each client spent on each UTC day; a day closes when the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    day = timed.groupBy(F.window("at", "1 day").alias("w"), F.col("user_id").alias("client")).agg(
        F.count("*").alias("n"), F.sum("value").alias("spent")
    )
    return day.select("client", F.to_date("w.start").alias("day"), "n", "spent")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of one user's events, apart by more than the gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    s = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str) -> StreamingQuery:
    """Writes each batch's latest row per key as one more folder; ``read_latest`` folds them. A retried batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
