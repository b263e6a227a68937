"""op6: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.neardup import near_duplicates
from loomspark.registry import Registry
from loomspark.sources.tables import read


_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS size FROM w),
windows AS (
  SELECT doc_id, size, p, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
), shingles AS (SELECT DISTINCT doc_id, k FROM windows WHERE n = 4 OR (size < 4 AND p = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
lowest AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.y, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l USING (doc_id)
"""


def register(llm: Registry) -> None:
    @llm.query("op6_neardup", _ORACLE)
    def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
        return near_duplicates(spark, read(spark, sf_dir, "documents"), words=4)
