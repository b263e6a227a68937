"""op13: the prefix trie of conversations that borrow the beginning of every fifth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch
from loomspark.llm.trie import build, number
from loomspark.registry import Registry
from loomspark.sources.tables import read

#: Every so manyth conversation lends its beginning; most turns that are borrowed, and one.
_EVERY, _HEADS = 5, 9

# CRC-32 bit by bit: DuckDB has none.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
  range(8 * length(CAST(conv_id AS VARCHAR))),
  lambda i: CAST((ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))),
  lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

_ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT DISTINCT conv_id, CAST({_CRC} AS BIGINT) % {_HEADS} AS h FROM t),
w AS (
  SELECT c.conv_id, 0 AS part, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {_EVERY} AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.p > c.h
), r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, strlen(text) AS size,
  sha256(strlen(role) || ':' || role || text) AS k FROM w),
n AS (SELECT conv_id, max(d) AS len FROM r GROUP BY conv_id),
pre AS (
  SELECT conv_id, d, size, string_agg(k, '/') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), m AS (SELECT pre.*, coalesce(n.len, 0) AS len FROM pre LEFT JOIN n USING (conv_id)),
node AS (
  SELECT key, any_value(d) AS depth, min(conv_id) AS id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM m GROUP BY key
), up AS (SELECT *, CASE WHEN depth > 1 THEN left(key, length(key) - 65) WHEN depth = 1 THEN '' END AS above FROM node),
kids AS (SELECT above AS key, count(*) AS n_children FROM up WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT a.key, count(*) FILTER (WHERE kids.key IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM up a JOIN up b ON a.key = '' OR b.key = a.key OR starts_with(b.key, a.key || '/') LEFT JOIN kids ON kids.key = b.key GROUP BY a.key
)
SELECT up.id AS conv_id, CAST(up.depth AS BIGINT) AS depth, p.id AS parent_conv_id, up.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, up.ends_sha256
FROM up JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN up p ON p.key = up.above
"""


def rebuilt(own: DataFrame) -> DataFrame:
    """Numbered turns of every conversation with its borrowed beginning, numbered anew."""
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % _HEADS
    lender = F.col("conv_id") - F.col("conv_id") % _EVERY
    kept = own.groupBy("conv_id").agg(F.sum(F.when(F.col("pos") <= heads, F.col("size")).otherwise(0)).alias("cut"))
    borrow = kept.select(F.col("conv_id").alias("taker"), "cut", heads.alias("h"), lender.alias("conv_id"))
    first = own.where(F.col("pos") < _HEADS).join(borrow, "conv_id").where("pos <= h")
    head = first.select(F.col("taker").alias("conv_id"), "pos", "key", "size", "before")
    had = first.groupBy("taker").agg(F.count("*").alias("k"), F.sum("size").alias("held"))
    moved = borrow.join(had, "taker", "left").select(
        F.col("taker").alias("conv_id"),
        "h",
        (F.coalesce("k", F.lit(0)) - F.col("h")).alias("shift"),
        (F.coalesce("held", F.lit(0)) - F.col("cut")).alias("more"),
    )
    tail = own.join(moved, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "key", "size", (F.col("before") + F.col("more")).alias("before")
    )
    return head.unionByName(tail)


def register(llm: Registry) -> None:
    @llm.query("op13_prefix_trie", _ORACLE)
    def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
        scratch = Scratch(spark, "trie")
        turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
        own = scratch.keep(number(scratch, turns), "own")
        return build(scratch, own.select("conv_id"), scratch.keep(rebuilt(own), "rebuilt"))
