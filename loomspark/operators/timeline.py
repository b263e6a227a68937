"""Operators over timed rows of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: seconds of a grid cell that no island leaves.
CELL = 120.0


def islands(cues: DataFrame, gap: float, cell: float = CELL) -> DataFrame:
    """Adds ``island``, numbered from 1 in each video.

    A cue joins the island before it if the gap is small enough, both begin in
    one cell and neither crosses its cell's end. Gap 0 leaves every cue alone.
    """
    w = W.partitionBy("video_id").orderBy("start_s", "cue_id")
    end, start = F.lag("end_s").over(w), F.lag("start_s").over(w)
    of = lambda x: F.floor(x / cell)
    whole = lambda s, e: e <= (of(s) + 1) * cell
    joins = (
        F.lit(gap > 0)
        & start.isNotNull()
        & (F.col("start_s") - end <= gap)
        & (of(F.col("start_s")) == of(start))
        & whole(F.col("start_s"), F.col("end_s"))
        & whole(start, end)
    )
    marked = cues.withColumn("__new", F.when(joins, 0).otherwise(1))
    return marked.withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def island_rows(numbered: DataFrame) -> DataFrame:
    """One row per island: bounds, cues and their joined text, in time order."""
    rows = F.sort_array(F.collect_list(F.struct("start_s", "cue_id", "text")))
    return numbered.groupBy("video_id", "island").agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.count("*").alias("n_cues"),
        F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"),
    )


def in_span(points: DataFrame, spans: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Points inside closed spans of the same key: an equality with a range left over, never a loop over all pairs."""
    s = spans.withColumnRenamed(key, "__key")
    return points.join(s, (F.col(key) == F.col("__key")) & (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__key")


def subdivide(spans: DataFrame, longest: float) -> DataFrame:
    """Spans in equal pieces no longer than about ``longest``; the last ends exactly where its span does."""
    pieces = F.greatest(F.lit(1), F.floor((F.col("end_s") - F.col("start_s")) / longest).cast("int"))
    step = (F.col("end_s") - F.col("start_s")) / F.col("pieces")
    cut = spans.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    last = F.col("piece") == F.col("pieces") - 1
    return cut.withColumn("piece_start", F.col("start_s") + F.col("piece") * step).withColumn(
        "piece_end", F.when(last, F.col("end_s")).otherwise(F.col("start_s") + (F.col("piece") + 1) * step)
    )


def context(cues: DataFrame, moments: DataFrame, before: float, after: float, budget: int) -> DataFrame:
    """Cues of each asked video (video_id, t) that overlap the time round ``t``, in order, up to a budget of characters.

    Adds ``used``, the characters so far, and ``bound``: what ended the list, the
    ``window`` or the ``budget``. The first cue that goes beyond the budget ends it, as
    do all after it; a budget of 0 is none. A window holds few cues of a video, whatever its length.
    """
    asked = moments.select(F.col("video_id").alias("__v"), "t")
    near = (F.col("video_id") == F.col("__v")) & (F.col("end_s") >= F.col("t") - before) & (F.col("start_s") <= F.col("t") + after)
    inside = cues.join(asked, near).drop("__v", "t")
    w = W.partitionBy("video_id").orderBy("start_s", "cue_id")
    used = F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))
    counted = inside.withColumn("used", used).withColumn("__most", F.max("used").over(W.partitionBy("video_id")))
    bound = F.when((F.lit(budget) > 0) & (F.col("__most") > budget), "budget").otherwise("window")
    kept = counted.withColumn("bound", bound).drop("__most")
    return kept.where(F.col("used") <= budget) if budget else kept
