"""Queries that lay two series of frames side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import alignment as A
from loomspark.plans import corpus as C
from loomspark.registry import core

_A, _B = "kind = 'click'", "kind = 'view'"


def _asof(a: str, b: str) -> str:
    """Moments of ``a`` with the distance to the nearest of ``b``: the last one at or before it, and the first after."""
    return f"""SELECT x.video_id, x.t_s, least(x.t_s - lo.t_s, hi.t_s - x.t_s) AS delta FROM {a} x
  ASOF LEFT JOIN {b} lo ON x.video_id = lo.video_id AND x.t_s >= lo.t_s ASOF LEFT JOIN {b} hi ON x.video_id = hi.video_id AND x.t_s <= hi.t_s"""


@core.query(
    "boundary_drift",
    f"""WITH {C.FRAMES}, a AS (SELECT video_id, CAST(t_s AS DOUBLE) AS t_s FROM frames WHERE {_A}), b AS (SELECT video_id, CAST(t_s AS DOUBLE) AS t_s FROM frames WHERE {_B}),
f AS ({_asof('a', 'b')}), r AS ({_asof('b', 'a')}),
x AS (SELECT video_id, count(*) AS count_a, round(avg(delta), 4) AS mean_s, round(max(delta), 4) AS max_s, count(*) FILTER (delta > 0.3) AS moved, round(arg_max(t_s, (delta, -t_s)), 3) AS worst_s FROM f GROUP BY video_id),
y AS (SELECT video_id, count(*) AS count_b, round(max(delta), 4) AS reverse_max_s FROM r GROUP BY video_id)
SELECT video_id, coalesce(count_a, 0) AS count_a, coalesce(count_b, 0) AS count_b, CASE WHEN count_a > 0 AND count_b > 0 THEN mean_s END AS mean_s, CASE WHEN count_a > 0 AND count_b > 0 THEN max_s END AS max_s,
 CASE WHEN count_a > 0 AND count_b > 0 THEN reverse_max_s END AS reverse_max_s, CASE WHEN count_a > 0 AND count_b > 0 THEN moved END AS moved, CASE WHEN count_a > 0 AND count_b > 0 THEN worst_s END AS worst_s
FROM x FULL JOIN y USING (video_id)""",
)
def boundary_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two sets of boundaries of a video lie apart, both ways."""
    frames = C.frames(spark, sf_dir).select("video_id", F.col("t_s").cast("double").alias("t_s"), "kind")
    return A.drift(frames.where(_A), frames.where(_B), "video_id", "t_s")


@core.query(
    "frame_pairs",
    f"""WITH RECURSIVE {C.FRAMES}, a AS (SELECT video_id, frame_id, t_s, phash, row_number() OVER (PARTITION BY video_id ORDER BY t_s, frame_id) AS k FROM frames WHERE {_A}),
b AS (SELECT video_id, frame_id, t_s, phash FROM frames WHERE {_B}),
m AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS b FROM a WHERE k = 1
  UNION ALL SELECT s.video_id, s.k, CASE WHEN s.b IS NULL THEN s.used ELSE list_append(s.used, s.b) END, s.b FROM (
    SELECT m.video_id, a.k, m.used, arg_min(b.frame_id, (abs(b.t_s - a.t_s), b.t_s, b.frame_id)) FILTER (b.frame_id IS NOT NULL) AS b
    FROM m JOIN a ON a.video_id = m.video_id AND a.k = m.k + 1 LEFT JOIN b ON b.video_id = m.video_id AND abs(b.t_s - a.t_s) <= 3600 AND NOT list_contains(m.used, b.frame_id)
    GROUP BY m.video_id, a.k, m.used) s)
SELECT m.video_id, a.frame_id AS a, m.b, CAST(abs(b.t_s - a.t_s) AS DOUBLE) AS dt, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS bits
FROM m JOIN a USING (video_id, k) LEFT JOIN b ON b.frame_id = m.b""",
)
def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that two ways of choosing have kept within an hour of each other, and how alike they are."""
    frames = C.frames(spark, sf_dir)
    return A.pairs(frames.where(_A), frames.where(_B), "video_id", "t_s", "frame_id", F.col("phash"), within=3600.0)
