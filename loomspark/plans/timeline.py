"""Queries over cues, frames and spans in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators import timeline as T
from loomspark.operators.retrieval import first_of
from loomspark.plans import corpus as C
from loomspark.registry import core
from loomspark.sources.tables import read

_ISLANDS = f"""{C.CUES}, m AS (
  SELECT *, CASE WHEN start_s - lag(end_s) OVER w <= 4 AND floor(start_s / 120) = floor(lag(start_s) OVER w / 120)
    AND end_s <= (floor(start_s / 120) + 1) * 120 AND lag(end_s) OVER w <= (floor(lag(start_s) OVER w / 120) + 1) * 120 THEN 0 ELSE 1 END AS is_new
  FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY start_s, cue_id)),
i AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY video_id ORDER BY start_s, cue_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.islands(C.cues(spark, sf_dir), gap=4.0)


@core.query(
    "cue_islands",
    f"""WITH {_ISLANDS} SELECT video_id, island, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_cues,
 string_agg(text, ' ' ORDER BY start_s, cue_id) AS text FROM i GROUP BY video_id, island""",
)
def cue_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.island_rows(_islands(spark, sf_dir))


@core.query(
    "island_anchor",
    f"""WITH {_ISLANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, island ORDER BY length(text) DESC, start_s, cue_id) AS r FROM i)
SELECT video_id, island, cue_id AS anchor FROM r WHERE r = 1""",
)
def island_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The longest cue of an island stands for it; one aggregate, no second sort.
    key = F.struct(-F.length("text"), "start_s", "cue_id")
    return _islands(spark, sf_dir).groupBy("video_id", "island").agg(F.min_by("cue_id", key).alias("anchor"))


@core.query(
    "chunk_expand",
    f"""WITH {C.CUES}, h AS (SELECT video_id, seq // 3 AS chunk, min(cue_id) AS lo, max(cue_id) AS hi FROM cues GROUP BY ALL),
x AS (SELECT c.cue_id, h.chunk FROM cues c JOIN h ON c.video_id = h.video_id AND c.cue_id BETWEEN h.lo AND h.hi + 1)
SELECT cue_id, min(chunk) AS best_chunk FROM x GROUP BY cue_id""",
)
def chunk_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = C.cues(spark, sf_dir).select("video_id", "cue_id", "seq")
    chunks = cues.groupBy("video_id", F.expr("seq div 3").alias("chunk")).agg(F.min("cue_id").alias("lo"), (F.max("cue_id") + 1).alias("hi"))
    return T.in_span(cues, chunks, "video_id", "cue_id", "lo", "hi").groupBy("cue_id").agg(F.min("chunk").alias("best_chunk"))


@core.query(
    "chunk_spans",
    f"""WITH {C.CUES}, h AS (SELECT video_id, seq // 3 AS chunk, min(start_s) AS s, max(end_s) AS e FROM cues GROUP BY ALL)
SELECT video_id, chunk, s AS start_s, e AS end_s FROM h WHERE e >= 10 AND s <= 30""",
)
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.cues(spark, sf_dir).groupBy("video_id", F.expr("seq div 3").alias("chunk")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return chunks.where("end_s >= 10 AND start_s <= 30")


@core.query(
    "chunk_marks",
    f"""WITH {C.CUES} SELECT video_id, cue_id, seq % 3 = 0 AS opens, seq % 3 = 2 OR seq = max(seq) OVER (PARTITION BY video_id) AS closes, seq // 24 AS page FROM cues""",
)
def chunk_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = C.cues(spark, sf_dir)
    last = F.max("seq").over(W.partitionBy("video_id"))
    closes = (F.col("seq") % 3 == 2) | (F.col("seq") == last)
    return cues.select("video_id", "cue_id", (F.col("seq") % 3 == 0).alias("opens"), closes.alias("closes"), F.expr("seq div 24").alias("page"))


@core.query("interval_overlap", f"WITH {C.CUES} SELECT video_id, cue_id, start_s, end_s FROM cues WHERE end_s >= 14 AND start_s <= 21")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cues(spark, sf_dir).where("end_s >= 14 AND start_s <= 21").select("video_id", "cue_id", "start_s", "end_s")


@core.query(
    "chapter_at",
    f"""WITH {C.CUES}, ch AS (SELECT video_id, speaker AS title, min(start_s) AS s, max(end_s) AS e FROM cues GROUP BY ALL)
SELECT c.cue_id, count(*) AS n_chapters, min(ch.title) AS chapter FROM cues c JOIN ch ON c.video_id = ch.video_id AND c.start_s >= ch.s AND c.start_s < ch.e GROUP BY c.cue_id""",
)
def chapter_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = C.cues(spark, sf_dir)
    chapters = cues.groupBy(F.col("video_id").alias("v"), F.col("speaker").alias("title")).agg(F.min("start_s").alias("s"), F.max("end_s").alias("e"))
    inside = (F.col("video_id") == F.col("v")) & (F.col("start_s") >= F.col("s")) & (F.col("start_s") < F.col("e"))
    return cues.select("video_id", "cue_id", "start_s").join(chapters, inside).groupBy("cue_id").agg(F.count("*").alias("n_chapters"), F.min("title").alias("chapter"))


@core.query(
    "key_texts",
    f"""WITH {C.CUES}, b AS (SELECT *, ntile(3) OVER (PARTITION BY video_id ORDER BY start_s, cue_id) AS bucket FROM cues),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, bucket ORDER BY length(text) DESC, cue_id) AS r FROM b)
SELECT video_id, CAST(bucket AS INTEGER) AS bucket, cue_id FROM r WHERE r = 1""",
)
def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.ntile(3).over(W.partitionBy("video_id").orderBy("start_s", "cue_id"))
    rows = C.cues(spark, sf_dir).withColumn("bucket", bucket).withColumn("size", -F.length("text"))
    return first_of(rows, ["video_id", "bucket"], ["size", "cue_id"]).select("video_id", "bucket", "cue_id")


@core.query(
    "speaker_time",
    f"""WITH {C.CUES}, s AS (SELECT video_id, speaker, round(sum(end_s - start_s), 4) AS seconds, min(start_s) AS first_s FROM cues GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seconds DESC, speaker) AS r FROM s)
SELECT video_id, speaker, seconds, first_s FROM r WHERE r <= 8""",
)
def speaker_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = C.cues(spark, sf_dir).groupBy("video_id", "speaker").agg(F.round(F.sum(F.col("end_s") - F.col("start_s")), 4).alias("seconds"), F.min("start_s").alias("first_s"))
    order = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("seconds"), "speaker"))
    return time.withColumn("r", order).where("r <= 8").drop("r")


@core.query(
    "shot_timeline",
    f"""WITH {C.FRAMES} SELECT shot_id, min(t_s) AS start_s, max(t_s) AS end_s, count(*) AS n,
 count(*) FILTER (WHERE kind = 'view') AS n_views, count(*) FILTER (WHERE kind = 'error') AS n_errors FROM frames GROUP BY shot_id""",
)
def shot_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frames(spark, sf_dir).groupBy("shot_id").agg(
        F.min("t_s").alias("start_s"),
        F.max("t_s").alias("end_s"),
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == "view").alias("n_views"),
        F.count_if(F.col("kind") == "error").alias("n_errors"),
    )


@core.query(
    "shot_bars",
    f"""WITH {C.FRAMES}, s AS (SELECT shot_id, min(t_s) AS a, max(t_s) AS b FROM frames GROUP BY shot_id), t AS (SELECT min(a) AS lo, max(b) AS hi FROM s)
SELECT shot_id, round(100 * (a - lo) / (hi - lo)::DOUBLE, 4) AS left_pct, greatest(round(100 * (b - a) / (hi - lo)::DOUBLE, 4), 0.05::DOUBLE) AS width_pct FROM s, t""",
)
def shot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = C.frames(spark, sf_dir).groupBy("shot_id").agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"))
    span = C.frames(spark, sf_dir).agg(F.min("t_s").alias("lo"), F.max("t_s").alias("hi"))
    part = lambda x: F.round(100 * x / (F.col("hi") - F.col("lo")), 4)
    wide = F.greatest(part(F.col("b") - F.col("a")), F.lit(0.05))
    return shots.crossJoin(F.broadcast(span)).select("shot_id", part(F.col("a") - F.col("lo")).alias("left_pct"), wide.alias("width_pct"))


@core.query(
    "subdivide_spans",
    f"""WITH {C.CUES}, v AS (SELECT video_id, min(start_s) AS s, max(end_s) AS e FROM cues GROUP BY video_id),
n AS (SELECT *, greatest(1, CAST(floor((e - s) / 60) AS INTEGER)) AS pieces FROM v), p AS (SELECT *, unnest(range(0, pieces)) AS piece FROM n)
SELECT video_id, CAST(piece AS INTEGER) AS piece, round(s + piece * ((e - s) / pieces), 6) AS piece_start,
 round(CASE WHEN piece = pieces - 1 THEN e ELSE s + (piece + 1) * ((e - s) / pieces) END, 6) AS piece_end FROM p""",
)
def subdivide_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = C.cues(spark, sf_dir).groupBy("video_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return T.subdivide(spans, 60).select("video_id", "piece", F.round("piece_start", 6).alias("piece_start"), F.round("piece_end", 6).alias("piece_end"))


@core.query(
    "argmax_per_group",
    f"WITH {C.FRAMES} SELECT shot_id, arg_max(frame_id, (sharpness, -frame_id)) AS frame_id FROM frames GROUP BY shot_id",
)
def argmax_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frames(spark, sf_dir).groupBy("shot_id").agg(F.max_by("frame_id", F.struct("sharpness", -F.col("frame_id"))).alias("frame_id"))


@core.query("cover_frame", f"WITH {C.FRAMES} SELECT video_id, min(frame_id) AS frame_id FROM frames WHERE kind <> 'error' GROUP BY video_id")
def cover_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frames(spark, sf_dir).where("kind <> 'error'").groupBy("video_id").agg(F.min("frame_id").alias("frame_id"))


@core.query(
    "frame_documents",
    f"""WITH {C.FRAMES} SELECT shot_id, string_agg(kind || ':' || video_id, ' | ' ORDER BY frame_id) AS text FROM frames GROUP BY shot_id""",
)
def frame_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("kind", F.lit(":"), "video_id")
    rows = F.sort_array(F.collect_list(F.struct("frame_id", line.alias("line"))))
    return C.frames(spark, sf_dir).groupBy("shot_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), " | ").alias("text"))


@core.query(
    "ocr_for_frames",
    f"""WITH {C.FRAMES}, w AS (SELECT video_id, kind, frame_id, row_number() OVER (PARTITION BY video_id, kind ORDER BY frame_id) AS r FROM frames)
SELECT video_id, kind, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frame_ids FROM w WHERE r <= 5 GROUP BY ALL""",
)
def ocr_for_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(W.partitionBy("video_id", "kind").orderBy("frame_id"))
    page = C.frames(spark, sf_dir).withColumn("r", first).where("r <= 5")
    ids = F.transform(F.sort_array(F.collect_list("frame_id")), lambda x: x.cast("string"))
    return page.groupBy("video_id", "kind").agg(F.array_join(ids, ",").alias("frame_ids"))


@core.query(
    "uniform_thin",
    f"""WITH {C.FRAMES}, n AS (SELECT frame_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM frames),
k AS (SELECT *, CAST(floor((floor(i * 10 / n::DOUBLE)) * n / 10) AS BIGINT) AS a, CAST(floor((floor(i * 10 / n::DOUBLE) + 1) * n / 10) AS BIGINT) AS b FROM n)
SELECT video_id, frame_id FROM k WHERE n <= 10 OR i = a OR i = b""",
)
def uniform_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of a video's frames, those at floor(k * n / 10)."""
    w = W.partitionBy("video_id")
    rows = C.frames(spark, sf_dir).select(
        "video_id", "frame_id", (F.row_number().over(w.orderBy("frame_id")) - 1).alias("i"), F.count("*").over(w).alias("n")
    )
    k = F.floor(F.col("i") * 10 / F.col("n"))
    at = lambda x: F.floor(x * F.col("n") / 10)
    return rows.where((F.col("n") <= 10) | (F.col("i") == at(k)) | (F.col("i") == at(k + 1))).select("video_id", "frame_id")


@core.query(
    "budget_rolling",
    f"""WITH {C.FRAMES} SELECT frame_id, round(sum(sharpness) OVER (PARTITION BY video_id ORDER BY t_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 4) AS spent FROM frames""",
)
def budget_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = W.partitionBy("video_id").orderBy("t_s").rangeBetween(-86400, 0)
    return C.frames(spark, sf_dir).select("frame_id", F.round(F.sum("sharpness").over(day), 4).alias("spent"))


@core.query(
    "daily_budget",
    "SELECT user_id AS client, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS spent FROM events GROUP BY ALL",
)
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.col("ts")).alias("day")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("client"), day).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"))


@core.query(
    "segment_context",
    f"""WITH {C.CUES}, m AS (SELECT DISTINCT video_id, CAST(20 AS DOUBLE) AS t FROM cues WHERE video_id % 3 <> 0),
i AS (SELECT c.*, sum(length(text)) OVER (PARTITION BY video_id ORDER BY start_s, cue_id ROWS UNBOUNDED PRECEDING) AS used FROM cues c JOIN m USING (video_id) WHERE end_s >= t - 15 AND start_s <= t + 15),
b AS (SELECT *, CASE WHEN max(used) OVER (PARTITION BY video_id) > 900 THEN 'budget' ELSE 'window' END AS bound FROM i)
SELECT video_id, cue_id, CAST(used AS BIGINT) AS used, bound, printf('%d:%02d', CAST(floor(start_s) AS BIGINT) // 60, CAST(floor(start_s) AS BIGINT) % 60) || ' ' || speaker || ': ' || text AS line FROM b WHERE used <= 900""",
)
def segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said within 15 seconds of the twentieth second of two thirds of the videos, in 900 characters at most."""
    cues = C.cues(spark, sf_dir)
    moments = cues.where("video_id % 3 <> 0").select("video_id", F.lit(20.0).alias("t")).distinct()
    found = T.context(cues, moments, before=15.0, after=15.0, budget=900)
    second = F.floor("start_s")
    clock = F.format_string("%d:%02d", F.floor(second / 60), second % 60)
    line = F.concat(clock, F.lit(" "), "speaker", F.lit(": "), "text")
    return found.select("video_id", "cue_id", "used", "bound", line.alias("line"))
