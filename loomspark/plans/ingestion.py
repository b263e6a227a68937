"""Queries of the order-dependent ingestion steps; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import sequential as S
from loomspark.plans import corpus as C
from loomspark.registry import core
from loomspark.sources.tables import read


@core.query(
    "chunk_windows",
    f"""WITH RECURSIVE {C.CUES}, c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, cue_id) AS i FROM cues),
n AS (SELECT video_id, max(i) AS n FROM c GROUP BY video_id),
reach AS (SELECT a.video_id, a.i, a.start_s, coalesce(min(b.i) FILTER (b.end_s - a.start_s > 45) - 1, max(n)) AS j, min(b.i) FILTER (b.start_s >= a.start_s + 30) AS stride
  FROM c a JOIN n USING (video_id) LEFT JOIN c b ON b.video_id = a.video_id AND b.i > a.i GROUP BY a.video_id, a.i, a.start_s),
w AS (SELECT video_id, i, j, stride FROM reach WHERE i = 1
  UNION ALL SELECT r.video_id, r.i, r.j, r.stride FROM w JOIN n USING (video_id) JOIN reach r ON r.video_id = w.video_id AND r.i = greatest(least(coalesce(w.stride, w.j + 1), w.j + 1), w.i + 1) WHERE w.j < n),
t AS (SELECT w.video_id, w.i, w.j FROM w JOIN c ON c.video_id = w.video_id AND c.i BETWEEN w.i AND w.j GROUP BY ALL HAVING bool_or(trim(text) <> ''))
SELECT t.video_id, row_number() OVER (PARTITION BY t.video_id ORDER BY t.i) - 1 AS chunk, a.cue_id AS first_cue, b.cue_id AS last_cue, a.start_s, b.end_s
FROM t JOIN c a ON a.video_id = t.video_id AND a.i = t.i JOIN c b ON b.video_id = t.video_id AND b.i = t.j""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_windows(C.cues(spark, sf_dir))


@core.query("interpolate")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("seq") % 3 != 1, F.col("start_s"))
    rows = C.cues(spark, sf_dir).select("video_id", "seq", known.alias("start_s"))
    return S.interpolate(rows, "video_id", "seq", "start_s", floor=0.0, step=1.0)


#: Every third cue is said again twice, 30 milliseconds later each time; the last one lasts long.
_ECHOED = f"""{C.CUES}, e AS (SELECT video_id, cue_id * 10 + k AS cue_id, start_s + 0.03::DOUBLE * k AS start_s, end_s + 40::DOUBLE * (k // 2) AS end_s, text
  FROM cues, range(3) r(k) WHERE k = 0 OR cue_id % 3 = 0)"""


@core.query(
    "tidy_cues",
    f"""WITH RECURSIVE {_ECHOED}, o AS (SELECT *, least(greatest(end_s, start_s + 0.01::DOUBLE), start_s + 30) AS fit, row_number() OVER (PARTITION BY video_id ORDER BY start_s, end_s, cue_id) AS i
  FROM e WHERE trim(text) <> ''),
k AS (SELECT video_id, i, i AS last, true AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.video_id, o.i, CASE WHEN p.text = o.text AND abs(p.start_s - o.start_s) < 0.05 THEN k.last ELSE o.i END, NOT (p.text = o.text AND abs(p.start_s - o.start_s) < 0.05)
  FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1 JOIN o p ON p.video_id = k.video_id AND p.i = k.last),
s AS (SELECT o.*, lead(o.start_s) OVER (PARTITION BY video_id ORDER BY i) AS next FROM k JOIN o USING (video_id, i) WHERE kept)
SELECT video_id, cue_id, start_s, CASE WHEN fit > next THEN greatest(next, start_s + 0.01::DOUBLE) ELSE fit END AS end_s FROM s""",
)
def tidy_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.when(F.col("cue_id") % 3 == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = C.cues(spark, sf_dir).withColumn("k", F.explode(again))
    echoed = rows.select(
        "video_id", (F.col("cue_id") * 10 + F.col("k")).alias("cue_id"), (F.col("start_s") + F.lit(0.03) * F.col("k")).alias("start_s"), (F.col("end_s") + 40.0 * F.expr("k div 2")).alias("end_s"), "text"
    )
    return S.tidy(echoed).select("video_id", "cue_id", "start_s", "end_s")


@core.query("greedy_neardup")
def greedy_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy_neardup(C.frames(spark, sf_dir), bits=2)


@core.query("token_bucket")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_bucket(C.frames(spark, sf_dir), "video_id", "t_s", "frame_id", capacity=2, per_second=1 / 7200)


@core.query("wer")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole passage against the next one."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), r"\s+").alias("a"))
    after = words.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    both = words.join(after, "item_id")
    errors = S.word_errors(F.col("a"), F.col("b"))
    return both.select("item_id", errors.alias("errors"), F.round(errors / F.greatest(F.size("b"), F.lit(1)), 4).alias("wer"))


@core.query("ocr_collapse")
def ocr_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other cue's beginning also stands on the screen, two seconds in."""
    score = F.round(F.length("text") / 1000, 4)
    spoken = C.cues(spark, sf_dir).select("video_id", "cue_id", "start_s", "end_s", "text", score.alias("score"))
    shown = C.cues(spark, sf_dir).where("seq % 2 = 0").select(
        "video_id", F.col("cue_id").alias("line_id"), (F.col("start_s") + 2).alias("t_s"), F.substring("text", 1, 40).alias("text"), F.lit(0.5).alias("score")
    )
    return S.collapse_screen_text(spoken, shown)
