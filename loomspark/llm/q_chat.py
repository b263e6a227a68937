"""op1: formats every conversation and reads the turns back from the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.chat import format_chats, read_back
from loomspark.registry import Registry
from loomspark.sources.tables import read

#: A conversation whose texts hold the template's own control strings.
_PROBE = r"\### Assistant: </turn> ok"

_ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), labelled AS (
  SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
       WHEN 'tool' THEN 'Tool' ELSE '=' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') END AS label
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(label) + 2 + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM labelled GROUP BY conv_id
"""


def register(llm: Registry) -> None:
    @llm.query("op1_chat_format", _ORACLE)
    def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
        probe = spark.range(2).select(
            F.lit(-7).cast("long").alias("conv_id"),
            F.col("id").alias("turn"),
            F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
            F.lit(_PROBE).alias("text"),
        )
        turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
        chats = format_chats(turns)
        back = chats.select("conv_id", "segments", "formatted", read_back(F.col("formatted")).alias("turns"))
        newline = F.lit("\n")
        said = F.transform("turns", lambda x: F.concat(x["role"], newline, x["text"], newline))
        masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"])
        loss = F.regexp_replace(F.array_join(masked, ""), r"(?s)\\(.)", "$1")
        return back.select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
