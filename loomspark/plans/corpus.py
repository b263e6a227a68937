"""The corpus relations as views of the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.tables import read

#: The moment that clock-driven queries take for now.
NOW = 1_706_659_200  # 2024-01-31T00:00:00Z

CUES = """cues AS (
  SELECT conv_id AS video_id, conv_id * 1000 + turn AS cue_id, turn AS seq, role AS speaker,
    CAST(turn * 7 + conv_id % 5 + CASE WHEN turn >= 5 THEN 400 ELSE 0 END AS DOUBLE) AS start_s,
    CAST(turn * 7 + conv_id % 5 + CASE WHEN turn >= 5 THEN 400 ELSE 0 END AS DOUBLE)
      + least(length(coalesce(text, '')) / CAST(20 AS DOUBLE), CAST(6 AS DOUBLE)) AS end_s,
    coalesce(text, '') AS text
  FROM conversations)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed lines: a conversation is a video, a turn a cue, a role a speaker."""
    start = F.col("turn") * 7 + F.col("conv_id") % 5 + F.when(F.col("turn") >= 5, 400).otherwise(0)
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("cue_id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("speaker"),
        start.cast("double").alias("start_s"),
        (start.cast("double") + F.least(F.length(F.coalesce("text", F.lit(""))) / 20, F.lit(6.0))).alias("end_s"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


VIDEOS = """videos AS (
  SELECT doc_id AS video_id, source AS channel, left(text, 60) AS title, lang AS language,
    n_chars AS duration_s, text FROM documents)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries: a document is a video, its source a channel."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.col("source").alias("channel"),
        F.substring("text", 1, 60).alias("title"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("duration_s"),
        "text",
    )


FRAMES = """frames AS (
  SELECT event_id AS frame_id, user_id AS video_id, CAST(floor(epoch(ts)) AS BIGINT) AS t_s, event_type AS kind,
    value AS sharpness, (event_id * 2654435761) % 1024 AS phash, event_id // 40 AS shot_id FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled frames: a user is a video, an event a frame."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("frame_id"),
        F.col("user_id").alias("video_id"),
        epoch(F.col("ts")).alias("t_s"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("sharpness"),
        ((F.col("event_id") * F.lit(2654435761)) % 1024).alias("phash"),
        F.expr("event_id div 40").alias("shot_id"),
    )


def epoch(ts: Column) -> Column:
    """Whole seconds of a time without zone, taken as UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


STAGES = """stages AS (
  SELECT doc_id AS video_id, 'stt' AS stage, CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS state FROM labels
  UNION ALL
  SELECT doc_id, 'ocr', CASE WHEN toxic = 1 THEN 'pending' ELSE 'done' END FROM labels)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two processing stages for each labelled document."""
    labels = read(spark, sf_dir, "labels")
    one = lambda name, state: labels.select(F.col("doc_id").alias("video_id"), F.lit(name).alias("stage"), state.alias("state"))
    return one("stt", F.when(F.col("quality") == 1, "done").otherwise("failed")).unionByName(
        one("ocr", F.when(F.col("toxic") == 1, "pending").otherwise("done"))
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS client, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS state,
    CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, CAST(epoch(o_orderdate) AS BIGINT) AS created,
    o_totalprice AS cost FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work queue: an order is a job."""
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("client"),
        F.when(status == "F", "done").when(status == "O", "queued").otherwise("running").alias("state"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        epoch(F.col("o_orderdate")).alias("created"),
        F.col("o_totalprice").alias("cost"),
    )


ITEMS = """items AS (
  SELECT l_orderkey AS job_id, l_linenumber AS seq, l_partkey AS video_id,
    CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' ELSE CASE l_linestatus WHEN 'O' THEN 'queued' ELSE 'running' END END AS state,
    CASE WHEN l_discount >= 0.08 THEN 'E_RATE_LIMIT' WHEN l_discount >= 0.05 THEN 'E_FETCH' ELSE 'E_OTHER' END AS error_code,
    CAST(l_quantity AS BIGINT) AS attempts, l_extendedprice AS bytes, CAST(epoch(l_shipdate) AS BIGINT) AS beat FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of work: an order's line is an item."""
    flag, line, discount = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_partkey").alias("video_id"),
        F.when(flag == "R", "failed").when(flag == "A", "done").when(line == "O", "queued").otherwise("running").alias("state"),
        F.when(discount >= 0.08, "E_RATE_LIMIT").when(discount >= 0.05, "E_FETCH").otherwise("E_OTHER").alias("error_code"),
        F.col("l_quantity").cast("long").alias("attempts"),
        F.col("l_extendedprice").alias("bytes"),
        epoch(F.col("l_shipdate")).alias("beat"),
    )
