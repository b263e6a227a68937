"""op8: documents without the words of windows that stand earlier elsewhere."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.passages import dedup_passages
from loomspark.registry import Registry
from loomspark.sources.tables import read


_ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
windows AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM windows WHERE n = 20) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, p + o AS p FROM later, range(0, 20) t(o)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _digest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = raw.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def register(llm: Registry) -> None:
    @llm.query("op8_passages", _ORACLE)
    def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", "text")
        schema = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
        return dedup_passages(spark, docs, _digest, schema)
